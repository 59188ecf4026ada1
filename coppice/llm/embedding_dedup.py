"""Near-duplicate vectors: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k unit centroids of the unit rows of x; an empty cell takes the row worst served."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        best, who = np.full(len(x), -2.0), np.zeros(len(x), int)
        for i in range(0, len(x), 4096):
            s = x[i : i + 4096] @ c.T
            who[i : i + 4096] = s.argmax(1)
            best[i : i + 4096] = s.max(1)
        new = np.zeros_like(c)
        np.add.at(new, who, x)
        norm = np.linalg.norm(new, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        if len(empty):
            new[empty] = x[np.argsort(best)[: len(empty)]]
            norm = np.linalg.norm(new, axis=1)
        new /= np.maximum(norm, 1e-300)[:, None]
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return c


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows with the key of their class, one row per class of equal linkable vectors)."""
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False)), v).alias("v"))
    rows = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("k1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.reverse("v"))).alias("k2"))
    one = rows.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("rep", F.col("k1"))
    return rows.drop("v"), one


def lookups(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row of x, [row, cell] whether a linked vector can have that earlier cell as its home).

    A unit y with x.y >= least has y.w >= 0 for some w of length 1 only if x.w >= -sqrt(1 - least^2).  If y's home
    is cell i and x's is j, this holds for w along c_i - c_j, so no cell that holds a link is left out.  Of a pair's
    two cells the later looks up the earlier: each pair is evaluated once.
    """
    s = x @ c.T
    home = s.argmax(1)
    square = (c * c).sum(1)
    gap = np.sqrt(np.maximum(square[home][:, None] + square - 2 * (c[home] @ c.T), 0))
    reach = np.sqrt(max(0.0, 1 - least * least)) * gap if least > 0 else np.inf
    can = s >= s[np.arange(len(x)), home][:, None] - reach - 1e-6
    return home, can & (np.arange(len(c)) < home[:, None])


def links(one: DataFrame, least: float = 0.9, cell_size: int = 256, most_cells: int = 4096, sample: int = 20_000, block: int = 4096, most_lookups: float = 8.0, lengths: int = 64) -> DataFrame:
    """(rep, n_links, least_linked) rows to be summed: per class and block product, the number of other
    classes' vectors linked, and an edge to the least class of its component within the block.

    Centroids are fitted on at most ``sample`` classes, drawn by hash; every class is
    assigned to its nearest cell and looks up all earlier cells that can hold a link (``lookups``), so no
    link is lost.  Where the sample looks up more than ``most_lookups`` cells on average, cells are
    halved in number, down to 16 times their size: the bound rules little out there, and larger cells
    are met by fewer copies.  A cell of any size is dealt
    into blocks of about ``block`` vectors, as few as memory allows, since every pair of blocks needs a
    copy of both; their products are made a strip of rows at a time and
    spread over the tasks; what leaves a task is one row a vector, not the pairs.
    Each of the ``lengths`` most common lengths has centroids; a cell of any other length is all of its vectors.
    """
    spark = one.sparkSession
    dims = [r["d"] for r in one.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").limit(lengths).collect()]
    pieces = []
    for d in dims:
        part = one.where(F.size("v") == d)
        total = part.count()
        k = min(most_cells, max(1, total // cell_size))
        drawn = part.select("v", F.xxhash64("rep").alias("h")).orderBy("h").limit(sample).select("v").toArrow()["v"].combine_chunks()
        x = _unit(drawn)
        fitted = spherical_kmeans(x, min(k, len(x)))
        fewest = max(1, k // 16)
        while k > fewest and lookups(x[:1024], fitted, least)[1].sum(1).mean() > most_lookups:
            k = max(fewest, k // 2)
            fitted = spherical_kmeans(x, min(k, len(x)))
        pieces.append(_cells(_assigned(part, spark.sparkContext.broadcast(fitted), least), least, block))
    if len(dims) == lengths:
        rest = one.where(~F.size("v").isin(dims)).select("rep", "n", "v", F.array(F.size("v")).alias("near"))
        pieces.append(_cells(rest, least, block, few=False))
    out = pieces[0] if pieces else spark.createDataFrame([], "rep long, n_links long, least_linked long")
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def _assigned(part: DataFrame, cells, least: float) -> DataFrame:
    """rep, n, v and near: the home cell, then the cells looked up."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                s = b.slice(i, 1024)
                home, can = lookups(_unit(s.column("v")), cells.value, least)
                near = [[h, *np.flatnonzero(c).tolist()] for h, c in zip(home.tolist(), can)]
                yield pa.RecordBatch.from_arrays([s.column("rep"), s.column("n"), s.column("v"), pa.array(near, pa.list_(pa.int32()))], ["rep", "n", "v", "near"])

    return part.select("rep", "n", "v").mapInArrow(assign, f"rep long, n long, v {dict(part.dtypes)['v']}, near array<int>")


#: Rows of a block that are multiplied with all of the other's at once.
STRIP = 512


def _linked(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float, same: bool):
    """(whether a row of ``a`` links with one of ``b``, the vectors that each links with on the other side)."""
    m = np.empty((len(a), len(b)), bool)
    links_a, links_b = np.zeros(len(a)), np.zeros(len(b))
    for i in range(0, len(a), STRIP):
        strip = m[i : i + STRIP]
        np.greater_equal(a[i : i + STRIP] @ b.T, least, out=strip)
        if same:
            strip[np.arange(len(strip)), np.arange(i, i + len(strip))] = False
        if strip.any():
            weight = strip.astype(np.float64)
            links_a[i : i + STRIP] = weight @ n_b
            links_b += n_a[i : i + STRIP] @ weight
    return m, links_a, links_b


def _labels(m: np.ndarray, rep_a: np.ndarray, rep_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least label over the links of a block pair, for both sides."""
    lab_a, lab_b = rep_a.copy(), rep_b.copy()
    rows, cols = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
    if not len(rows):
        return lab_a, lab_b
    m = m[np.ix_(rows, cols)]
    big = np.iinfo(np.int64).max
    a, b = lab_a[rows], lab_b[cols]
    while True:
        before = a, b
        new_b = b.copy()
        new_a = a.copy()
        for i in range(0, len(a), STRIP):
            strip = m[i : i + STRIP]
            new_b = np.minimum(new_b, np.where(strip, a[i : i + STRIP, None], big).min(0))
        for i in range(0, len(a), STRIP):
            new_a[i : i + STRIP] = np.minimum(new_a[i : i + STRIP], np.where(m[i : i + STRIP], new_b[None, :], big).min(1))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)  # rows and columns are the same vectors
        a, b = new_a, new_b
        if (a == before[0]).all() and (b == before[1]).all():
            lab_a[rows], lab_b[cols] = a, b
            return lab_a, lab_b


def _cells(near: DataFrame, least: float, block: int, few: bool = True) -> DataFrame:
    near = near.withColumn("home", F.col("near")[0])
    spread = near.select("rep", "n", "v", "home", F.explode("near").alias("cell"))
    sizes = near.groupBy(F.col("home").alias("cell")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    guests = near.select(F.col("home"), F.explode("near").alias("cell")).groupBy("cell").agg(F.ceil(F.sum((F.col("cell") != F.col("home")).cast("int")) / block).cast("int").alias("guest_blocks"))
    at = sizes.join(guests, "cell")
    placed = spread.join(F.broadcast(at) if few else at, "cell").withColumn("member", F.col("cell") == F.col("home"))  # few: a row for each of at most most_cells cells
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("member"), F.col("blocks")).otherwise(F.greatest(F.lit(1), F.col("guest_blocks")))).cast("int")
    placed = placed.withColumn("mine", mine)
    every = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    # A member's block i meets member blocks j >= i, and each guest block; guest blocks are numbered below 0.
    with_members = F.transform(every(F.col("blocks")), lambda j: F.struct(F.least(F.col("mine"), j).alias("i"), F.greatest(F.col("mine"), j).alias("j")))
    with_guests = F.slice(F.transform(every(F.col("guest_blocks")), lambda g: F.struct((-1 - g).alias("i"), F.col("mine").alias("j"))), F.lit(1), F.col("guest_blocks"))
    as_guest = F.transform(every(F.col("blocks")), lambda j: F.struct((-1 - F.col("mine")).alias("i"), j.alias("j")))
    dealt = placed.withColumn("t", F.explode(F.when(F.col("member"), F.concat(with_members, with_guests)).otherwise(as_guest)))

    def product(table: pa.Table) -> pa.Table:
        i = table["i"][0].as_py()
        mine, member = table["mine"].to_numpy(), table["member"].to_numpy(zero_copy_only=False)
        x = _unit(table["v"].combine_chunks())
        rep, n = table["rep"].to_numpy(), table["n"].to_numpy()
        j = table["j"][0].as_py()
        right = np.flatnonzero(member & (mine == j))
        left = right if i == j else np.flatnonzero(member & (mine == i)) if i >= 0 else np.flatnonzero(~member)
        if not len(left) or not len(right):
            return table.schema.empty_table().select([]).append_column("rep", pa.array([], pa.int64())).append_column("n_links", pa.array([], pa.int64())).append_column("least_linked", pa.array([], pa.int64()))
        m, links_l, links_r = _linked(x[left], x[right], n[left], n[right], least, i == j)
        lab_l, lab_r = _labels(m, rep[left], rep[right], i == j)
        parts = [(left, links_l, lab_l)] if i == j else [(left, links_l, lab_l), (right, links_r, lab_r)]
        who = np.concatenate([rep[a] for a, _, _ in parts])
        count = np.concatenate([b for _, b, _ in parts]).astype(np.int64)
        lab = np.concatenate([c for _, _, c in parts])
        some = (count > 0) | (lab != who)
        return pa.table({"rep": pa.array(who[some], pa.int64()), "n_links": pa.array(count[some]), "least_linked": pa.array(lab[some], pa.int64())})

    cols = dealt.select("rep", "n", "v", "cell", "member", "mine", F.col("t.i").alias("i"), F.col("t.j").alias("j"))
    return cols.groupBy("cell", "i", "j").applyInArrow(product, "rep long, n_links long, least_linked long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Equal vectors are one class: they link with one another and are compared once.
    Vectors that are null, empty, zero or not finite, and rows with a null id, link
    with nothing and are their own component.  Vectors of other lengths never link.
    Rows that repeat an id count as vectors of their own.
    """
    rows, one = classes(vectors, id_col, vec_col)
    one, rows = cut(one), cut(rows)
    found = cut(links(one, least, **how))
    comp = connected_components(found.where("rep <> least_linked").select(F.col("rep").alias("a"), F.col("least_linked").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    of = one.select("k1", "k2", "rep", "n", "least").join(sums, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of = cut(of.select("k1", "k2", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("root")))
    of = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root", "least")
    out = rows.where("k1 is not null").join(of, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    # Vectors that link with nothing stay out of the join, where they would be one key.
    out = out.unionByName(rows.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
