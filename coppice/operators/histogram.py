"""Histograms: cells of gradient, hessian and row sums by node, feature and bin."""

from __future__ import annotations

import numpy as np


def add(out: np.ndarray, bins: np.ndarray, features: np.ndarray, width: int, slot: np.ndarray, rows: np.ndarray | None, g: np.ndarray, h: np.ndarray | None) -> None:
    """Adds rows to ``out`` [3, features, slots * width]; ``rows`` (none: all) have a slot, a gradient and a hessian each.

    Without ``h`` every hessian is 1, and its sums are the counts: see ``finish``.
    """
    size = out.shape[2]
    base = slot.astype(np.intp) * width
    for j, f in enumerate(features):
        at = base + (bins[f] if rows is None else bins[f][rows])
        out[0, j] += np.bincount(at, g, size)
        out[2, j] += np.bincount(at, minlength=size)
        if h is not None:
            out[1, j] += np.bincount(at, h, size)


def finish(out: np.ndarray, unit: bool) -> np.ndarray:
    if unit:
        out[1] = out[2]
    return out


def subtract(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The sibling's cells as parent minus child, without reading its rows; what rounding leaves in empty cells goes."""
    rest = parent - child
    rest[rest[..., 2] < 0.5] = 0
    return rest


def totals(cells: np.ndarray, feature: int = 0) -> tuple[float, float, int]:
    """A node's sums, from any one feature's cells."""
    g, h, n = cells[feature].sum(0)
    return float(g), float(h), int(round(n))
