"""Named datasets over the star-schema tables: what benchmarks and examples fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """``tier`` is what it is for: "pin" (small, compared to the digit), "quality" or "scale"."""

    name: str
    tier: str
    task: str
    features: tuple[str, ...]
    label: str
    row_id: str | None
    table: str
    columns: Callable[[DataFrame], DataFrame]

    def load(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.columns(spark.read.parquet(f"{folder}/{self.table}.parquet"))


def _prices(df: DataFrame) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1992-01-01")).alias("day")
    return df.select("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", day, F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))


def _purchases(df: DataFrame) -> DataFrame:
    return df.select("event_id", "value", F.hour("ts").alias("hour"), F.get_json_object("props", "$.k").cast("float").alias("k"), (F.col("event_type") == "purchase").cast("int").alias("purchase"))


def _vectors(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", *[F.col("embedding")[i].alias(f"x{i}") for i in range(64)])


DATASETS = {
    d.name: d
    for d in (
        Dataset("prices", "scale", "regression", ("l_quantity", "l_discount", "l_tax", "l_linenumber", "day", "part", "supplier"), "l_extendedprice", None, "lineitem", _prices),
        Dataset("purchases", "quality", "binary", ("value", "hour", "k"), "purchase", "event_id", "events", _purchases),
        Dataset("vectors", "quality", "multiclass", tuple(f"x{i}" for i in range(64)), "label", "vec_id", "embeddings", _vectors),
    )
}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(DATASETS)}")
    return DATASETS[name]


def of_tier(tier: str) -> list[Dataset]:
    return [d for d in DATASETS.values() if d.tier == tier]
