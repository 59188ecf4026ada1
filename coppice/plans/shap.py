"""Exact Shapley values of trees from their packed leaf paths.

The features of a leaf's path that repeat are merged into one interval and one share of
cover.  Which of the path's d features a row satisfies is one of 2**d patterns, and a
pattern fixes the contribution of every feature; so the table of a path is built once
a task, and a row costs a lookup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np

from .trees import Tree

#: Beyond so many features on a path its patterns are evaluated for the rows at hand, not tabled.
TABLED = 12


@dataclass
class Path:
    fids: np.ndarray
    lo: np.ndarray  # a value satisfies the feature if lo < v <= hi, a missing one if ``missing``
    hi: np.ndarray
    missing: np.ndarray
    zero: np.ndarray  # the share of cover that the feature's splits send this way
    value: float
    gone: np.ndarray  # what stands for a missing value


def pack(trees: list[Tree], last: np.ndarray | None = None) -> list[Path]:
    """The paths of the trees' leaves, over values; with ``last``, the last bin of each feature, over bins."""
    out = []
    for t in trees:
        for leaf, path in t.paths():
            by: dict[int, list] = {}
            for n, left in path:
                child = t.left[n] if left else t.right[n]
                x = by.setdefault(t.fid[n], [-np.inf, np.inf, True, 1.0])
                edge = np.float32(t.threshold[n]) if last is None else t.bin[n]
                if left:
                    x[1] = min(x[1], edge)
                else:
                    x[0] = max(x[0], edge)
                x[2] &= bool(t.default_left[n]) == left
                x[3] *= t.cover[child] / t.cover[n] if t.cover[n] else 0.0
            if by and not any(x[3] == 0 and not t.cover[leaf] for x in by.values()):
                f = sorted(by)
                out.append(Path(np.array(f), *(np.array([by[i][k] for i in f]) for k in range(4)), t.value[leaf], np.full(len(f), np.inf) if last is None else last[f]))
    return out


def _weights(d: int) -> np.ndarray:
    """1 / (d * C(d - 1, k)) for k other features."""
    return np.array([1.0 / (d * comb(d - 1, k)) for k in range(d)])


def _contributions(ones: np.ndarray, zero: np.ndarray, value: float) -> np.ndarray:
    """[patterns, d] from boolean ``ones`` [patterns, d]: each feature's change, averaged over the sets of the others."""
    n, d = ones.shape
    o = ones.astype(float)
    w = _weights(d)
    out = np.empty((n, d))
    for i in range(d):
        poly = np.ones((n, 1))  # by the number of features known: products of ones for them, zeros for the rest
        for j in range(d):
            if j != i:
                grown = np.zeros((n, poly.shape[1] + 1))
                grown[:, :-1] += poly * zero[j]
                grown[:, 1:] += poly * o[:, j : j + 1]
                poly = grown
        out[:, i] = value * (o[:, i] - zero[i]) * (poly @ w)
    return out


def _satisfied(v: np.ndarray, lo: float, hi: float, there: np.ndarray) -> np.ndarray:
    """Whether the values, NaN where missing, are in (lo, hi]."""
    if lo == -np.inf:
        return v <= hi if hi != np.inf else there
    return (v > lo) & (v <= hi) if hi != np.inf else v > lo


def tables(paths: list[Path]) -> list[np.ndarray | None]:
    """The contributions of each path's patterns [d, 2**d], where they are few."""
    out = []
    for p in paths:
        d = len(p.fids)
        every = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1 == 1 if d <= TABLED else None
        out.append(None if every is None else np.ascontiguousarray(_contributions(every, p.zero, p.value).T))
    return out


def evaluate(paths: list[Path], x: np.ndarray, n_features: int, known: list[np.ndarray | None] | None = None) -> np.ndarray:
    """[rows, features] sums of the paths' contributions; ``known`` are their ``tables``."""
    phi = np.zeros((n_features, len(x)))
    values, there = {}, {}
    for f in {int(f) for p in paths for f in p.fids}:
        gone = next(p.gone[list(p.fids).index(f)] for p in paths if f in p.fids)
        v = x[:, f].astype(np.float32)
        v[v == gone] = np.nan
        values[f], there[f] = v, ~np.isnan(v)
    for p, table in zip(paths, known or tables(paths)):
        ones = []
        for f, lo, hi, missing in zip(p.fids.tolist(), p.lo, p.hi, p.missing):
            ok = _satisfied(values[f], lo, hi, there[f])
            ones.append(ok | ~there[f] if missing else ok)
        if table is None:
            for f, c in zip(p.fids, _contributions(np.stack(ones, 1), p.zero, p.value).T):
                phi[f] += c
            continue
        code = np.zeros(len(x), np.int16)
        for i, ok in enumerate(ones):
            code |= ok.astype(np.int16) << np.int16(i)
        for f, c in zip(p.fids, table):
            phi[f] += c.take(code)
    return phi.T


def path_rows(paths: list[Path]) -> Iterator[tuple]:
    """(path, fid, lo, hi, missing, zero, value) rows."""
    for i, p in enumerate(paths):
        for k in range(len(p.fids)):
            yield i, int(p.fids[k]), float(p.lo[k]), float(p.hi[k]), bool(p.missing[k]), float(p.zero[k]), float(p.value)
