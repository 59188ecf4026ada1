"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("u > v").distinct()


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Alternates the large-star and small-star steps until the edges stop changing.
    Minima are aggregated before they are joined, so a hub's neighbours never
    meet in one task other than as a skewed join that AQE can split.  Self loops,
    repeated edges and null ends are dropped; no edges give no rows.  Rounds go on until
    nothing changes; with ``max_rounds`` a graph that needs more is an error, never a wrong answer.
    """
    e = cut(_pairs(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null")))
    before = _signature(e)
    done, rounds = not before[0], 0
    while not done:
        if rounds == max_rounds:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _pairs(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        e = cut(_pairs(small))
        after = _signature(e)
        done, before, rounds = after == before, after, rounds + 1
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
