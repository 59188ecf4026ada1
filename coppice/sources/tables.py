"""Tables made or cut for training: synthetic regression data, hold-out splits, category codes."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import with_rank


def _uniform(row: Column, column: str, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5, so that any engine can make the same."""
    text = F.concat_ws(":", row.cast("string"), F.lit(column), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def friedman(spark: SparkSession, rows: int, columns: int, seed: int = 42, informative: int = 20) -> DataFrame:
    """row_id, f0.. in [0, 1), label: blocks of five informative columns, each weighing 0.6 of the one before,
    and noise of a third of the signal's deviation.  Each value depends on its row, column and seed alone."""
    if columns < 5:
        raise ValueError("five columns at least")
    r = spark.range(rows).withColumnRenamed("id", "row_id")
    df = r.select("row_id", *[_uniform(F.col("row_id"), str(i), seed).cast("float").alias(f"f{i}") for i in range(columns)])
    signal = F.lit(0.0)
    for b in range(min(informative, columns) // 5):
        x = [F.col(f"f{5 * b + i}").cast("double") for i in range(5)]
        signal = signal + F.lit(0.6**b) * (10 * F.sin(F.lit(pi) * x[0] * x[1]) + 20 * (x[2] - 0.5) * (x[2] - 0.5) + 10 * x[3] + 5 * x[4])
    df = df.withColumn("_s", signal)
    sigma = (df.agg(F.stddev_pop("_s")).first()[0] or 0.0) / 3
    u1, u2 = (_uniform(F.col("row_id"), k, seed) for k in "ab")
    noise = F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * pi * u2)
    return df.withColumn("label", F.col("_s") + F.lit(sigma) * noise).drop("_s")


def holdout(df: DataFrame, row_id: str, share: float) -> DataFrame:
    """Adds is_eval: the last max(1, int(n * share)) rows by id."""
    n = df.count()
    k = max(1, int(n * share))
    return with_rank(df, [F.col(row_id).asc()], "_rn").withColumn("is_eval", F.col("_rn") >= n - k).drop("_rn")


def category_codes(df: DataFrame, column: str, out: str = "code", most: int = 1_000_000) -> DataFrame:
    """Adds the place of the value among the column's sorted distinct values; null stays null.

    The table of codes is broadcast up to ``most`` values, else joined.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = with_rank(values, [F.col(column).asc()], out)
    few = values.limit(most + 1).count() <= most
    return df.join(F.broadcast(codes) if few else codes, column, "left")
