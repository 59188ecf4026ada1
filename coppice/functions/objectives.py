"""Objectives: initial scores and links as plans, gradients and losses of a block of rows."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .ranking import nearest_rank

SCORE_CLIP = 30.0


def sigmoid(s: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-s))


@dataclass(frozen=True)
class Objective:
    """``p`` is the raw score, ``y`` the label."""

    name: str
    delta: float = 1.0
    alpha: float = 0.5
    n_classes: int = 1

    @property
    def task(self) -> str:
        return {"logloss": "binary", "softmax": "multiclass"}.get(self.name, "regression")

    @property
    def default_metric(self) -> str:
        return {"binary": "logloss", "multiclass": "mc_accuracy"}.get(self.task, "mae" if self.name == "mae" else "rmse")

    @property
    def unit_hessian(self) -> bool:
        return self.name in ("mse", "mae", "huber", "quantile")

    @property
    def renews(self) -> bool:
        return self.name in ("mae", "huber", "quantile")

    def grad_hess(self, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and hessian of each row at raw score ``p``; of several classes, arrays [rows, classes]."""
        if self.name == "softmax":
            q = np.exp(p - p.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            return q - (y.astype(int)[:, None] == np.arange(p.shape[1])), np.maximum(q * (1 - q), 1e-6)
        if self.name == "logloss":
            s = 1 / (1 + np.exp(-p))
            return s - y, s * (1 - s)
        if self.name == "poisson":
            e = np.exp(np.clip(p, -SCORE_CLIP, SCORE_CLIP))
            return e - y, e
        d = p - y
        grad = {"mse": lambda: d, "mae": lambda: np.sign(d), "huber": lambda: np.clip(d, -self.delta, self.delta), "quantile": lambda: np.where(d > 0, 1 - self.alpha, -self.alpha)}[self.name]()
        return grad, np.ones_like(d)

    def loss(self, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The loss of each row; the evaluation is its mean."""
        if self.name == "softmax":
            top = p.max(1)
            return top + np.log(np.exp(p - top[:, None]).sum(1)) - p[np.arange(len(p)), y.astype(int)]
        if self.name == "logloss":
            return np.maximum(0, p) + np.log1p(np.exp(-np.abs(p))) - y * p
        if self.name == "poisson":
            f = np.clip(p, -SCORE_CLIP, SCORE_CLIP)
            return np.exp(f) - y * f
        d = p - y
        a = np.abs(d)
        if self.name == "huber":
            return np.where(a <= self.delta, 0.5 * a * a, self.delta * (a - 0.5 * self.delta))
        return {"mse": lambda: d * d, "mae": lambda: a, "quantile": lambda: np.where(d <= 0, self.alpha * a, (1 - self.alpha) * a)}[self.name]()

    def link(self, p: Column) -> Column:
        return sigmoid(p) if self.name == "logloss" else F.exp(p) if self.name == "poisson" else p

    def init_score(self, df: DataFrame, label: str = "label") -> float:
        y = F.col(label).cast("double")
        if self.name in ("mse", "logloss", "poisson"):
            m, least, odd = df.agg(F.avg(y), F.min(y), F.sum(F.isnan(y).cast("int"))).first()
            if m is None:
                raise ValueError("no rows to train on")
            if self.name == "mse":
                return float(m)
            if self.name == "logloss":
                m = min(max(float(m), 1e-15), 1 - 1e-15)
                return log(m / (1 - m))
            if odd or least < 0:
                raise ValueError("poisson labels are counts: neither negative nor NaN")
            return log(max(float(m), 1e-9))
        alpha = self.alpha if self.name == "quantile" else 0.5
        rows = nearest_rank(df.select(y.alias("y")), "y", alpha).collect()
        if not rows:
            raise ValueError("no rows to train on")
        return float(rows[0]["q"])


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def softmax_init(df: DataFrame, n_classes: int, label: str = "label") -> list[float]:
    """ln(max(count, 1) / n) of each class."""
    rows = df.groupBy(F.col(label).cast("int").alias("k")).count().collect()
    by = {r["k"]: r["count"] for r in rows}
    if any(k is None or not 0 <= k < n_classes for k in by):
        raise ValueError(f"labels must be classes 0 to {n_classes - 1}")
    n = sum(by.values())
    return [log(max(by.get(k, 0), 1) / max(n, 1)) for k in range(n_classes)]


def of(config: Config) -> Objective:
    o = config.objective
    return Objective(config.dispatch.objective_name, o.huber_delta, o.quantile_alpha, o.n_classes if config.dispatch.objective_name == "softmax" else 1)
