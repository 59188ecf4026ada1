"""Positions in a global order without gathering rows in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The order key is a bijection on 32-bit ids: an odd multiplier modulo 2**32.
MULTIPLIER, MODULUS = 2654435761, 1 << 32


def order_key(row_id: Column | str, seed: int = 0) -> Column:
    """A pseudo-random number below 2**32 of any whole id, the same in any engine with 64-bit integers.

    It is the id modulo 2**32, either sign, times an odd number modulo 2**32.  The factors are multiplied by
    halves of 16 bits, so that no product overflows.
    """
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    factor = (MULTIPLIER + 2 * seed) % MODULUS
    low = F.pmod(c.cast("long"), F.lit(MODULUS))
    high, rest = F.shiftright(low, 16), low.bitwiseAND(0xFFFF)
    return F.pmod(F.pmod(high * F.lit(factor), F.lit(1 << 16)) * F.lit(1 << 16) + rest * F.lit(factor), F.lit(MODULUS))


def order_keys(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """``order_key`` of an array of ids."""
    return (ids.astype(np.int64).view(np.uint64) & np.uint64(MODULUS - 1)) * np.uint64((MULTIPLIER + 2 * seed) % MODULUS) & np.uint64(MODULUS - 1)


def whole_id(df: DataFrame, row_id: str) -> Column:
    """The id as a long: whole numbers are themselves, anything else is hashed; null stays null."""
    return F.col(row_id).cast("long") if dict(df.dtypes)[row_id] in ("bigint", "int", "smallint", "tinyint") else F.when(F.col(row_id).isNotNull(), F.xxhash64(row_id))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in a single process, where it may be unset, a private one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows from a table in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``written`` made, in whatever store it is."""
    jvm, context = spark._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def running_total(df: DataFrame, order: list[Column], value: Column, name: str, groups: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each, in the order, or within its group.

    Rows are range-partitioned by the order, summed up within their partition, and
    shifted by the totals of the partitions ahead; only a total for each partition (and
    group) is gathered, so no task ever holds more than its range.  The ranges are
    checkpointed: bounds are sampled, and both passes have to see the same ones.
    """
    groups = groups or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(g) for g in groups], *order).withColumn("_part", F.spark_partition_id())
    ranged = checkpoint(ranged.withColumn("_value", value.cast("long")))
    inside = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_in", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    totals = ranged.groupBy("_part", *groups).agg(F.sum("_value").alias("_n"))
    ahead = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    if not groups:  # a row a partition; with groups they are joined
        before = F.broadcast(before)
    return within.join(before, ["_part", *groups]).withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before", "_value")


def with_rank(df: DataFrame, order: list[Column], name: str = "rn", groups: list[str] | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in the order, or within its group."""
    return running_total(df, order, F.lit(1), name, groups)


def half_up(x: Column) -> Column:
    """Rounded half away from zero, as a long."""
    return F.round(x).cast("long")


def nearest_rank(df: DataFrame, value: str, alpha: float, groups: list[str] | None = None, out: str = "q") -> DataFrame:
    """The value at index round(alpha * (n - 1)) of each group's ascending values; nulls are left out."""
    groups = groups or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    ranked = running_total(counts, [F.col("_v").asc()], F.col("_k"), "_below", groups)
    sizes = counts.groupBy(*groups).agg(F.sum("_k").alias("_c"))
    hit = ranked.join(sizes, groups) if groups else ranked.join(F.broadcast(sizes), F.lit(True))  # without groups one row
    at = F.least(half_up(F.lit(alpha) * (F.col("_c") - 1)), F.col("_c") - 1)
    return hit.where((F.col("_below") <= at) & (at < F.col("_below") + F.col("_k"))).select(*groups, F.col("_v").alias(out))


def sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order; -0.0 counts as 0.0."""
    u = (x.astype(np.float64) + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def unsorted(u: np.ndarray) -> np.ndarray:
    """The doubles that ``sortable`` made these of."""
    u = np.asarray(u, np.uint64)
    return np.where(u >> np.uint64(63), u ^ np.uint64(1 << 63), ~u).view(np.float64)


#: Counts that a pass may send from a partition, and keys that are few enough to be sorted by the driver.
MOST_COUNTS, FEW_KEYS = 1 << 20, 50_000


def select(df: DataFrame, emit: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], rank: Callable[[np.ndarray], np.ndarray], n_groups: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, keys below it, keys equal to it) at a rank of each group's ascending keys, without sorting or shuffling rows.

    ``emit`` turns a batch into groups below ``n_groups`` and unsigned 64-bit keys; ``rank`` turns
    the groups' sizes into 0-based ranks.  Each pass counts the keys that share the digits
    found so far by their next one, so a partition sends a bounded number of counts; once few
    keys are left, they are sorted.  A group without keys has key 0.
    """
    found, below, size, want = np.zeros(n_groups, np.uint64), np.zeros(n_groups, np.int64), np.zeros(n_groups, np.int64), None
    digit, done = int(np.clip((MOST_COUNTS // n_groups).bit_length() - 1, 4, 16)), 64

    def alike(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        group, key = emit(b)
        if done < 64:
            same = key >> np.uint64(done) == found[group] >> np.uint64(done)
            group, key = group[same], key[same]
        return group.astype(np.int64), key

    while done:
        if want is not None and size.sum() <= FEW_KEYS:
            return _few_left(df, alike, found, below, size, want)
        bits = min(digit, done)
        shift = done - bits

        def run(batches: Iterator[pa.RecordBatch], bits: int = bits, shift: int = shift) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_groups << bits, np.int64)
            for b in batches:
                group, key = alike(b)
                part = (key >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                total += np.bincount((group << bits) + part.astype(np.int64), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

        got = df.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(n_groups << bits, np.int64)
        counts[got["cell"].to_numpy()] = got["n"].to_numpy()
        counts = counts.reshape(n_groups, -1)
        if want is None:
            want = np.asarray(rank(counts.sum(1)), np.int64)
        ends = below[:, None] + counts.cumsum(1)
        at = np.minimum((ends <= want[:, None]).sum(1), counts.shape[1] - 1)
        rows = np.arange(n_groups)
        size = counts[rows, at]
        below = ends[rows, at] - size
        found = found | at.astype(np.uint64) << np.uint64(shift)
        done = shift
    return found, below, size


def _few_left(df: DataFrame, alike, found: np.ndarray, below: np.ndarray, size: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, key = alike(b)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(key.view(np.int64))], ["group", "key"])

    got = df.mapInArrow(run, "group long, key long").toArrow()
    group, key = got["group"].to_numpy(), got["key"].to_numpy().view(np.uint64)
    order = np.lexsort((key, group))
    group, key = group[order], key[order]
    found, below, size = found.copy(), below.copy(), size.copy()
    for g in np.unique(group).tolist():
        own = key[slice(*np.searchsorted(group, [g, g + 1]))]
        found[g] = own[want[g] - below[g]]
        first, last = np.searchsorted(own, found[g], side="left"), np.searchsorted(own, found[g], side="right")
        below[g], size[g] = below[g] + first, last - first
    return found, below, size
