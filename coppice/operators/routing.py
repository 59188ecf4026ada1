"""Which child a row goes to: a predicate on bins, and the same on raw values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def goes_left(b: np.ndarray, last: np.ndarray, split_bin: np.ndarray, default_left: np.ndarray) -> np.ndarray:
    """Bins up to the split's go left; the last bin holds missing values."""
    return np.where(b == last, default_left, b <= split_bin)


def raw_goes_left(v: Column, threshold: float, default_left: bool) -> Column:
    """The same predicate on the raw float value."""
    f = v.cast("float")
    return F.when(f.isNull() | F.isnan(f), F.lit(default_left)).otherwise(f <= F.lit(threshold).cast("float"))


def leaf_of_bins(t: dict[str, np.ndarray], bins: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``bins`` [features, rows]; a growing tree's open nodes are leaves."""
    node = np.zeros(bins.shape[1], np.int32)
    if t["fid"][0] < 0:
        return node
    live = np.arange(bins.shape[1])
    while len(live):
        n = node[live]
        f = t["fid"][n]
        b = bins[f, live]
        to = np.where(goes_left(b, last[f], t["bin"][n], t["default_left"][n]), t["left"][n], t["right"][n])
        node[live] = to
        live = live[t["fid"][to] >= 0]
    return node


def leaf_of_values(t: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of each row of float32 values; infinity follows missing values, as it does in bins."""
    node = np.zeros(len(x), np.int32)
    live = np.arange(len(x)) if t["fid"][0] >= 0 else np.zeros(0, int)
    while len(live):
        n = node[live]
        f = t["fid"][n]
        v = x[live, f]
        to = np.where(np.where(np.isnan(v) | (v == np.inf), t["default_left"][n], v <= t["threshold"][n]), t["left"][n], t["right"][n])
        node[live] = to
        live = live[t["fid"][to] >= 0]
    return node
