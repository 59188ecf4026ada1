"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components


def simhash(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a text; 0 where it has no word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        parts = [joined]
    else:
        lengths = np.fromiter(map(len, w), np.int64, len(w))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(w) - shingle + 1].tolist()
        parts = [joined[i:j] for i, j in zip(starts, ends[shingle - 1 :].tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):  # the bit matrix of a long text stays small
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([simhash(t.as_py()) for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null texts count as empty, repeated rows stay."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_fingerprints, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def links(fps: DataFrame, distance: int = 3, crowd: int = 4096) -> DataFrame:
    """(a, b) for distinct fingerprints ``fp`` that differ in 1 to ``distance`` bits (at most 3); a pair may come twice.

    The 64 bits make two segments of 32.  Two fingerprints within three bits differ
    by at most one bit in one of the segments, so the ball of radius one around each
    segment value meets the other's table entry.  Of two values one bit apart, only
    the one whose bit is 0 looks up the other: half the lookups find every pair.
    Values that more than ``crowd`` fingerprints share are split by the other segment: of its
    four bytes one at least is equal within three bits, so entries and lookups meet by each byte, and a
    pair is taken at the first byte that is equal.
    Candidates are verified in the join condition; only links become rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one cover 0 to 3 bits")
    low = F.lit((1 << 32) - 1).cast("long")
    seg = lambda fp, i: F.col(fp).bitwiseAND(low) if i == 0 else F.shiftrightunsigned(fp, 32)
    key = lambda i: seg("fp", i).bitwiseOR(F.lit(i << 32).cast("long"))
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])

    def ball(i: int):
        k = key(i)
        return F.concat(F.array(k), F.transform(F.filter(bits, lambda m: k.bitwiseAND(m) == 0), lambda m: k.bitwiseOR(m)))

    entries = fps.select(F.col("fp").alias("b"), F.explode(F.array(key(0), key(1))).alias("k"))
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.concat(ball(0), ball(1))).alias("k"))
    crowded = cut(entries.groupBy("k").count().where(F.col("count") > crowd).select("k"))
    on = ["k"]
    if n := crowded.count():
        mark = crowded.withColumn("split", F.lit(True))
        mark = F.broadcast(mark) if n <= 100_000 else mark

        def parts(df: DataFrame, fp: str) -> DataFrame:
            other = F.when(F.col("k") < F.lit(1 << 32), seg(fp, 1)).otherwise(seg(fp, 0))
            by_byte = F.array(*[F.shiftright(other, 8 * j).bitwiseAND(0xFF) + (256 * j + 1) for j in range(4)])
            return df.join(mark, "k", "left").select(fp, "k", other.alias("other"), F.explode(F.when(F.col("split"), by_byte).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))

        entries, probes, on = parts(entries, "b"), parts(probes, "a"), ["k", "part"]
    ok = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    e, p = entries.alias("e"), probes.alias("p")
    if n:
        differ = F.col("p.other").bitwiseXOR(F.col("e.other"))
        for j in range(3):  # a byte before the part's own that is equal has found the pair already
            ok &= (F.col("p.part") <= 256 * (j + 1)) | (F.shiftright(differ, 8 * j).bitwiseAND(0xFF) != 0)
    for c in on:
        ok = (F.col(f"p.{c}") == F.col(f"e.{c}")) & ok
    return p.join(e, ok).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the least id reachable over links, itself included.  Exact
    copies share a fingerprint and so never multiply candidates.  Rows with a null
    id take part and get their group's least id, null if the group has none.
    """
    fp = cut(fingerprints(docs, id_col, text_col))
    groups = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = connected_components(links(groups.select("fp"), distance))
    rooted = groups.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return fp.join(of, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(c: str = "fp"):
    return F.lower(F.lpad(F.hex(c), 16, "0"))
