"""Standings of libraries over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standings(results: DataFrame) -> DataFrame:
    """(lib, mean_rank, wins) from (lib, seed, task, score): means over seeds, then ranks within tasks, higher is better."""
    means = results.groupBy("lib", "task").agg(F.avg("score").alias("score"))
    ranks = means.withColumn("rk", F.rank().over(Window.partitionBy("task").orderBy(F.desc("score"))))
    return ranks.groupBy("lib").agg(F.round(F.avg("rk"), 4).alias("mean_rank"), F.sum((F.col("rk") == 1).cast("long")).alias("wins"))
