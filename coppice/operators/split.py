"""Split search over a node's cells: prefix sums over bins, both directions for missing values, and a total order of candidates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import Tree


@dataclass
class Split:
    """A node's split on the driver; sums of its two sides."""

    gain: float
    fid: int
    bin: int
    default_left: bool
    left: tuple[float, float, int]
    right: tuple[float, float, int]


def np_soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def np_score(g, h, l1: float, l2: float):
    d = h + l2
    return np.where(d > 0, np_soft(g, l1) ** 2 / np.where(d > 0, d, 1.0), 0.0)


def np_weight(g, h, l1: float, l2: float, lo: float = -np.inf, hi: float = np.inf):
    d = h + l2
    return np.clip(np.where(d > 0, -np_soft(g, l1) / np.where(d > 0, d, 1.0), 0.0), lo, hi)


@dataclass
class Candidates:
    """All candidates of a node's cells [features, bins, (grad, hess, count)], last axis of two: missing values left, right."""

    left: np.ndarray  # [features, bins, 2, 3] sums of the left side
    total: np.ndarray  # [features, 3] sums of the node, as each feature's cells give them
    ok: np.ndarray  # [features, bins, 2] which exist and may be taken
    gain: np.ndarray

    @classmethod
    def of(cls, cells: np.ndarray, n_bins: np.ndarray, tree: Tree, allowed: np.ndarray | None = None, lo: float = -np.inf, hi: float = np.inf, sign: np.ndarray | None = None, gate: bool = True) -> Candidates:
        """A cut is at every bin but the last real one and the missing one; the second direction only where values are missing.

        ``gate``: nodes of fewer than twice ``min_data_in_leaf`` rows have none.
        """
        f = np.arange(len(n_bins))
        miss = cells[f, n_bins - 1]
        real = cells.copy()
        real[f, n_bins - 1] = 0
        run = real.cumsum(1)
        total = run[:, -1] + miss
        left = np.stack([run + miss[:, None], run], axis=2)
        right = total[:, None, None] - left
        ok = np.repeat((np.arange(cells.shape[1])[None, :] <= n_bins[:, None] - 3)[:, :, None], 2, axis=2)
        ok[:, :, 1] &= (miss != 0).any(1)[:, None]
        ok &= (left[..., 1] >= tree.min_child_hess) & (right[..., 1] >= tree.min_child_hess)
        l1, l2 = tree.lambda_l1, tree.lambda_l2
        if gate:
            ok &= (total[:, 2] >= 2 * tree.min_data_in_leaf)[:, None, None] & (left[..., 2] >= 0.5) & (right[..., 2] >= 0.5)
        if allowed is not None:
            ok &= allowed[:, None, None]
        if sign is not None and sign.any():
            wl, wr = (np_weight(x[..., 0], x[..., 1], l1, l2, lo, hi) for x in (left, right))
            ok &= sign[:, None, None] * (wr - wl) >= 0
        gain = np_score(left[..., 0], left[..., 1], l1, l2) + np_score(right[..., 0], right[..., 1], l1, l2) - np_score(total[:, 0], total[:, 1], l1, l2)[:, None, None]
        return cls(left, total, ok, gain)

    def sides(self, f: int, b: int, d: int) -> tuple[tuple[float, float, int], tuple[float, float, int]]:
        left, right = self.left[f, b, d], self.total[f] - self.left[f, b, d]
        return tuple((float(x[0]), float(x[1]), int(round(x[2]))) for x in (left, right))


def find(cells: np.ndarray, n_bins: np.ndarray, tree: Tree, allowed: np.ndarray | None = None, lo: float = -np.inf, hi: float = np.inf, sign: np.ndarray | None = None, first: int = 0) -> Split | None:
    """The node's candidate of the greatest positive gain; ties go to the lowest feature, then bin, then missing left.

    ``first`` is the number of the cells' first feature.
    """
    c = Candidates.of(cells, n_bins, tree, allowed, lo, hi, sign)
    gain = np.where(c.ok, c.gain, -np.inf)
    at = int(gain.argmax())
    if not gain.flat[at] > 0 or gain.flat[at] < tree.min_gain_to_split:
        return None
    f, b, d = np.unravel_index(at, gain.shape)
    left, right = c.sides(f, b, d)
    return Split(float(gain.flat[at]), first + int(f), int(b), bool(d == 0), left, right)


def find_level(nodes: list[np.ndarray], n_bins: np.ndarray, tree: Tree, allowed: np.ndarray | None = None, first: int = 0) -> list[Split] | None:
    """One cut for all nodes, of the greatest sum of gains, where a node that can't take it adds nothing; each node's sides, the sum as gain."""
    each = [Candidates.of(cells, n_bins, tree, allowed, gate=False) for cells in nodes]
    total = np.where(np.any([c.ok for c in each], axis=0), sum(np.where(c.ok, c.gain, 0.0) for c in each), -np.inf)
    at = int(total.argmax())
    if not total.flat[at] > 0 or total.flat[at] < tree.min_gain_to_split:
        return None
    f, b, d = np.unravel_index(at, total.shape)
    return [Split(float(total.flat[at]), first + int(f), int(b), bool(d == 0), *c.sides(f, b, d)) for c in each]
