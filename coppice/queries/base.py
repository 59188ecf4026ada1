"""The views that the queries share, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """q, d (missing from 0.08 on), t, y, w, r of lineitem."""
    return table(spark, d, "lineitem").select(
        F.col("l_quantity").cast("float").alias("q"), F.when(F.col("l_discount") < 0.08, F.col("l_discount").cast("float")).alias("d"),
        F.col("l_tax").cast("float").alias("t"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") / 25.0).alias("w"), (F.col("l_returnflag") == "R").cast("double").alias("r"),
    )


LINES = "lines AS (SELECT l_quantity::FLOAT AS q, CASE WHEN l_discount < 0.08 THEN l_discount::FLOAT END AS d, l_tax::FLOAT AS t, l_extendedprice AS y, l_quantity / 25.0 AS w, CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END AS r FROM lineitem)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, v (missing above 100), h, k, value, kind (0 to 4), buy."""
    kind = F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("event_type")).cast("int") - 1
    return table(spark, d, "events").select(
        "event_id", F.when(F.col("value") <= 100, F.col("value").cast("float")).alias("v"), F.hour("ts").cast("float").alias("h"), F.get_json_object("props", "$.k").cast("float").alias("k"),
        "value", kind.alias("kind"), (F.col("event_type") == "purchase").cast("double").alias("buy"),
    )


EVENTS = "ev AS (SELECT event_id, CASE WHEN value <= 100 THEN value::FLOAT END AS v, hour(ts)::FLOAT AS h, (props->>'$.k')::FLOAT AS k, value, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS kind, CASE WHEN event_type = 'purchase' THEN 1.0e0 ELSE 0.0e0 END AS buy FROM events)"

PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def orders(spark: SparkSession, d: str) -> DataFrame:
    """id, a (month), b (a day of the month, missing for every seventh id), c (the customer's last digits), y (price), k (status 0 to 2)."""
    status = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")).cast("int") - 1
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.month("o_orderdate").cast("float").alias("a"), F.when(F.col("o_orderkey") % 7 != 0, F.dayofmonth("o_orderdate").cast("float")).alias("b"),
        (F.col("o_custkey") % 100).cast("float").alias("c"), F.col("o_totalprice").alias("y"), status.alias("k"),
    )


ORDERS = "ord AS (SELECT o_orderkey AS id, month(o_orderdate) AS a, CASE WHEN o_orderkey % 7 <> 0 THEN day(o_orderdate) END AS b, o_custkey % 100 AS c, o_totalprice::FLOAT::DOUBLE AS y, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS k FROM orders)"

SIGMOID = "(1.0e0 / (1.0e0 + exp(-({}))))"


def key(column: str, seed: int = 0) -> str:
    return f"(((({column}::HUGEINT % 4294967296 + 4294967296) % 4294967296) * {2654435761 + 2 * seed}) % 4294967296)"


class Catalog:
    """Collects queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def add(f):
            n = name or f.__name__
            self.queries[n] = f
            if sql is not None:
                self.sql[n] = sql
            return f

        return add
