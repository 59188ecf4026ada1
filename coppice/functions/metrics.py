"""Metrics as aggregate plans over a score and a label column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running_total

TASKS = {"rmse": "regression", "mae": "regression", "r2": "regression", "logloss": "binary", "accuracy": "binary", "auc": "binary", "mc_accuracy": "multiclass"}


def _d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def rmse(p: str, y: str) -> Column:
    return F.sqrt(F.avg((_d(p) - _d(y)) * (_d(p) - _d(y))))


def mae(p: str, y: str) -> Column:
    return F.avg(F.abs(_d(p) - _d(y)))


def r2(p: str, y: str, weight: str | None = None, constant: float | None = float("nan")) -> Column:
    """1 - residual / total sum of squares; constant labels give ``constant`` (None: 1 for a perfect fit, else 0)."""
    w = _d(weight) if weight else F.lit(1.0)
    sw, sy, syy = F.sum(w), F.sum(w * _d(y)), F.sum(w * _d(y) * _d(y))
    res = F.sum(w * (_d(y) - _d(p)) * (_d(y) - _d(p)))
    flat = F.max(_d(y)) == F.min(_d(y))
    none = F.when(res == 0, 1.0).otherwise(0.0) if constant is None else F.lit(constant)
    return F.when(flat, none).otherwise(1.0 - res / (syy - sy * sy / sw))


def logloss(p: str, y: str) -> Column:
    """On raw scores."""
    s = _d(p)
    return F.avg(F.greatest(F.lit(0.0), s) + F.log1p(F.exp(-F.abs(s))) - _d(y) * s)


def accuracy(p: str, y: str, weight: str | None = None) -> Column:
    """Scores of 0.5 and more are class 1, as are labels."""
    w = _d(weight) if weight else F.lit(1.0)
    return F.sum(w * ((_d(p) >= 0.5) == (_d(y) >= 0.5)).cast("double")) / F.sum(w)


def mc_accuracy(p: str, y: str) -> Column:
    return F.avg((F.round(_d(p)) == F.round(_d(y))).cast("double"))


def auc(df: DataFrame, p: str, y: str, one_class: float = 1.0, name: str = "value", positive: Callable[[Column], Column] = lambda y: y >= 0.5) -> DataFrame:
    """Rank-sum AUC with ties averaged; ``one_class`` where labels are all positive or all not.

    Rows are first summed by score, then ranges of scores are summed, so that the
    running count of what lies below needs neither all rows nor all scores in a task.
    """
    ties = df.groupBy(_d(p).alias("s")).agg(F.sum(positive(_d(y)).cast("long")).alias("pos"), F.count("*").alias("n"))
    below = running_total(ties, [F.col("s").asc()], F.col("n"), "below")
    ranked = below.withColumn("rank_sum", F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0))
    got = ranked.agg(F.sum("rank_sum").alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return got.select(F.when((F.col("p") == 0) | (F.col("q") == 0), F.lit(one_class)).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p").cast("double") * F.col("q"))).alias(name))


def bench_auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """AUC as the benchmarks have it: labels above 0 are positive, and one class has none."""
    return auc(df, p, y, float("nan"), positive=lambda y: y > 0)


def bench_r2(p: str, y: str) -> Column:
    """R squared as the benchmarks have it: none of constant labels."""
    return r2(p, y, constant=float("nan"))


_AGG = {"rmse": rmse, "mae": mae, "r2": r2, "logloss": logloss, "accuracy": accuracy, "mc_accuracy": mc_accuracy}


def resolve(name: str, task: str) -> str:
    """The name, if the metric is known and fits the task."""
    if name not in TASKS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(TASKS)}")
    if TASKS[name] != task and not (name in ("rmse", "mae") and task == "binary"):
        raise ValueError(f"metric {name!r} is for {TASKS[name]} tasks, not {task}")
    return name


def evaluate(df: DataFrame, name: str, p: str, y: str) -> DataFrame:
    """One row with the metric as ``value``."""
    if name == "auc":
        return auc(df, p, y)
    return df.agg(_AGG[name](p, y).alias("value"))
