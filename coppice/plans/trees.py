"""Trees as arrays, their walks, and their table form."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Node arrays; a leaf has fid -1. ``bin`` is the split's cut position, ``threshold`` its value.

    Left takes bins up to ``bin``, or values up to ``threshold``; missing values go left if ``default_left``.
    """

    fid: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    default_left: list[bool] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)  # of an oblivious tree: a node of each level

    def add(self, cover: float, value: float = 0.0) -> int:
        for column, x in ((self.fid, -1), (self.bin, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.default_left, False), (self.value, value), (self.gain, 0.0), (self.cover, cover)):
            column.append(x)
        return len(self.fid) - 1

    def split(self, node: int, fid: int, at: int, threshold: float, default_left: bool, gain: float, covers: tuple[float, float]) -> tuple[int, int]:
        left, right = self.add(covers[0]), self.add(covers[1])
        self.fid[node], self.bin[node], self.threshold[node], self.default_left[node], self.gain[node] = fid, at, threshold, default_left, gain
        self.left[node], self.right[node] = left, right
        return left, right

    @property
    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.fid) if f < 0]

    def depth(self) -> int:
        deep = [0] * len(self.fid)
        for i, f in enumerate(self.fid):
            if f >= 0:
                deep[self.left[i]] = deep[self.right[i]] = deep[i] + 1
        return max(deep, default=0)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"fid": np.array(self.fid, np.int32), "bin": np.array(self.bin, np.int32), "threshold": np.array(self.threshold, np.float32), "left": np.array(self.left, np.int32), "right": np.array(self.right, np.int32), "default_left": np.array(self.default_left, bool), "value": np.array(self.value, np.float64)}

    def paths(self):
        """(leaf, [(node, went left)]) of every leaf."""
        todo = [(0, [])]
        while todo:
            i, path = todo.pop()
            if self.fid[i] < 0:
                yield i, path
            else:
                todo += [(self.right[i], [*path, (i, False)]), (self.left[i], [*path, (i, True)])]

    def expected(self) -> float:
        """The mean of the leaves by cover."""
        total = sum(self.cover[i] for i in self.leaves)
        return sum(self.cover[i] * self.value[i] for i in self.leaves) / total if total else 0.0

    def rows(self, tree: int) -> list[tuple]:
        return [(tree, i, self.fid[i], float(self.threshold[i]), self.left[i], self.right[i], bool(self.default_left[i]), float(self.value[i]), float(self.gain[i]), float(self.cover[i])) for i in range(len(self.fid))]


TABLE = "tree int, node int, fid int, threshold float, left int, right int, default_left boolean, value double, gain double, cover double"
