"""Row samplers: all rows, Bernoulli, and gradient-based one-side sampling; and feature subsets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Sampler
from ..functions.ranking import MODULUS, MULTIPLIER, order_keys, select, sortable

#: Ids as unsigned numbers of the same order.
FLIP = np.uint64(1 << 63)


def bernoulli(rid: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """Whether each row is drawn: with probability ``rate``, by its order key."""
    return order_keys(rid, seed) < rate * MODULUS


@dataclass(frozen=True)
class Edge:
    """A place in the order of (key, id): ``inside`` are the rows up to it."""

    key: int
    rid: int

    def inside(self, key: np.ndarray, rid: np.ndarray) -> np.ndarray:
        return (key < np.uint64(self.key)) | ((key == np.uint64(self.key)) & (rid.view(np.uint64) ^ FLIP <= np.uint64(self.rid)))


Rows = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def first_rows(df: DataFrame, emit: Rows, n: int) -> Edge:
    """The edge of the first ``n`` rows by the unsigned keys and the ids that ``emit`` makes of a batch."""
    none = lambda x: np.zeros(len(x), np.int64)
    key, below, equal = select(df, lambda b: (none(x := emit(b)[0]), x), lambda size: np.full(1, n - 1))
    if n - below[0] >= equal[0]:
        return Edge(int(key[0]), (1 << 64) - 1)

    def ties(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, rid = emit(b)
        at = rid[keys == key[0]].view(np.uint64) ^ FLIP
        return none(at), at

    rid, *_ = select(df, ties, lambda size: np.full(1, n - 1 - below[0]))
    return Edge(int(key[0]), int(rid[0]))


@dataclass(frozen=True)
class OneSide:
    """The rows of the largest absolute gradients, and some of the others that stand for the rest by ``scale``.

    Ties at a border go to the lower id.
    """

    top: Edge
    other: Edge | None
    scale: float
    seed: int

    @staticmethod
    def key(g: np.ndarray) -> np.ndarray:
        return sortable(-np.abs(g))

    @classmethod
    def fit(cls, df: DataFrame, rows: Rows, config: Sampler, seed: int, n_rows: int) -> OneSide | None:
        """``rows`` makes gradients and ids of a batch; none where all rows are kept."""
        top_k, other_k = int(config.top_rate * n_rows + 0.5), int(config.other_rate * n_rows + 0.5)
        if top_k == 0 or top_k >= n_rows:
            return None

        def by_size(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            g, rid = rows(b)
            return cls.key(g), rid

        top = first_rows(df, by_size, top_k)

        def by_key(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            size, rid = by_size(b)
            rest = rid[~top.inside(size, rid)]
            return order_keys(rest, seed), rest

        other = first_rows(df, by_key, min(other_k, n_rows - top_k)) if other_k else None
        return cls(top, other, (1.0 - config.top_rate) / config.other_rate if config.other_rate else 0.0, seed)

    def weights(self, g: np.ndarray, rid: np.ndarray) -> np.ndarray:
        """1 for a top row, ``scale`` for one that stands for others, 0 for the rest."""
        top = self.top.inside(self.key(g), rid)
        if self.other is None:
            return top.astype(float)
        return np.where(top, 1.0, np.where(self.other.inside(order_keys(rid, self.seed), rid), self.scale, 0.0))


def feature_subset(n_features: int, fraction: float, seed: int) -> list[int]:
    """ceil(fraction * n) features, one at least, in order: those of the least order keys."""
    k = max(1, -int(-(fraction * n_features) // 1))
    if k >= n_features:
        return list(range(n_features))
    return sorted(sorted(range(n_features), key=lambda i: (i * (MULTIPLIER + 2 * seed)) % MODULUS)[:k])
