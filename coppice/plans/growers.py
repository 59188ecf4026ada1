"""Tree growers as coroutines: each asks for the best splits of the nodes it has just made, and is sent them.

What a grower knows of a node are its sums, bounds and path; cells of histograms stay with the search that
answers.  The caller may answer the asks of several trees (one a class) with one job.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Generator
from dataclasses import dataclass, field

import numpy as np

from ..config import Tree as TreeConfig
from ..operators import split as S
from .trees import Tree

Sums = tuple[float, float, int]
#: What a node's search is bound by: features that may split it, and the range of its children's weights.
Limits = tuple[np.ndarray, float, float]


@dataclass
class Ask:
    """Best splits of the children of ``pairs`` (parent, left, right), or of the root where there are none."""

    tree: Tree
    pairs: list[tuple[int, int, int]]
    limits: dict[int, Limits]
    level: bool = False  # one cut for all of them


@dataclass
class Answer:
    splits: dict[int, S.Split] = field(default_factory=dict)  # of the nodes that have one
    total: Sums = (0.0, 0.0, 0)  # of the root, when it is asked for


Grower = Generator[Ask, Answer, Tree]


def interaction_groups(texts: list[str]) -> list[frozenset[int]]:
    """Sets of feature numbers from '0,1' or '0+1'."""
    groups = [t.replace("+", ",").split(",") for t in texts]
    for text, parts in zip(texts, groups):
        if not any(p.strip() for p in parts) or not all(p.strip().isdigit() for p in parts if p.strip()):
            raise ValueError(f"an interaction group is a list of feature numbers, not {text!r}")
    return [frozenset(int(p) for p in parts if p.strip()) for parts in groups]


def splittable(groups: list[frozenset[int]], path: frozenset[int]) -> frozenset[int] | None:
    """Features that may split a node below splits by ``path``; None: all.

    They are the union of the groups that hold the whole path, and a path's only feature.
    """
    if not groups or not path:
        return None
    around = frozenset().union(*(g for g in groups if g >= path))
    return around | path if len(path) == 1 else around


class _Frontier:
    """Sums, bounds and paths of a growing tree's nodes."""

    def __init__(self, config: TreeConfig, cuts: list[np.ndarray], selected: np.ndarray):
        self.config, self.cuts, self.selected, self.tree = config, cuts, selected, Tree()
        self.groups = interaction_groups(config.interaction_constraints)
        self.sign = [*config.monotone_constraints, *[0] * len(cuts)]
        self.total: dict[int, Sums] = {}
        self.bounds: dict[int, tuple[float, float]] = {0: (-np.inf, np.inf)}
        self.path: dict[int, frozenset[int]] = {0: frozenset()}
        self.tree.add(0.0)

    def begin(self, level: bool = False) -> Generator[Ask, Answer, Answer]:
        answer = yield Ask(self.tree, [], {0: self.limits(0)}, level)
        self.total[0] = answer.total
        self.tree.cover[0] = float(answer.total[2])
        return answer

    def limits(self, node: int) -> Limits:
        some = splittable(self.groups, self.path[node])
        mask = self.selected if some is None else self.selected & np.isin(np.arange(len(self.selected)), list(some))
        return mask, *self.bounds[node]

    def ask(self, pairs: list[tuple[int, int, int]], level: bool = False) -> Ask:
        return Ask(self.tree, pairs, {n: self.limits(n) for _, *kids in pairs for n in kids}, level)

    def weight(self, sums: Sums, lo: float = -np.inf, hi: float = np.inf) -> float:
        return float(S.np_weight(np.float64(sums[0]), np.float64(sums[1]), self.config.lambda_l1, self.config.lambda_l2, lo, hi))

    def split(self, node: int, s: S.Split, gain: float | None = None) -> tuple[int, int, int]:
        left, right = self.tree.split(node, s.fid, s.bin, float(self.cuts[s.fid][s.bin]), s.default_left, s.gain if gain is None else gain, (float(s.left[2]), float(s.right[2])))
        self.total[left], self.total[right] = s.left, s.right
        lo, hi = self.bounds[left] = self.bounds[right] = self.bounds[node]
        if sign := self.sign[s.fid]:
            mid = (self.weight(s.left, lo, hi) + self.weight(s.right, lo, hi)) / 2
            low, high = (left, right) if sign > 0 else (right, left)
            self.bounds[low], self.bounds[high] = (lo, min(hi, mid)), (max(lo, mid), hi)
        self.path[left] = self.path[right] = self.path[node] | {s.fid}
        return node, left, right

    def value(self, node: int, bounded: bool = True) -> float:
        return self.weight(self.total[node], *(self.bounds[node] if bounded else ()))


def depthwise(config: TreeConfig, cuts: list[np.ndarray], selected: np.ndarray) -> Grower:
    """Splits the whole frontier, level by level."""
    front = _Frontier(config, cuts, selected)
    found = (yield from front.begin()).splits
    for depth in range(config.max_depth):
        pairs = [front.split(n, s) for n, s in sorted(found.items())]
        if not pairs or depth + 1 == config.max_depth:
            break
        found = (yield front.ask(pairs)).splits
    for n in front.tree.leaves:
        front.tree.value[n] = front.value(n)
    return front.tree


def levelwise(config: TreeConfig, cuts: list[np.ndarray], selected: np.ndarray) -> Grower:
    """One split a level for all of its nodes, empty ones too; leaves take no bounds."""
    front = _Frontier(config, cuts, selected)
    found = (yield from front.begin(level=True)).splits
    for depth in range(config.max_depth):
        if not found:
            break
        nodes = sorted(found)
        pairs = [front.split(n, found[n], None if n == nodes[0] else 0.0) for n in nodes]
        front.tree.levels.append(nodes[0])
        if depth + 1 < config.max_depth:
            found = (yield front.ask(pairs, level=True)).splits
    for n in front.tree.leaves:
        front.tree.value[n] = front.value(n, bounded=False)
    return front.tree


def leafwise(config: TreeConfig, cuts: list[np.ndarray], selected: np.ndarray) -> Grower:
    """Best-first by gain up to ``max_leaves`` leaves (0: no bound), in at most ``max_depth`` asks.

    A node's best split doesn't depend on the order in which others are split.  So each
    round replays the heap over the splits known so far and expands, at once, every
    node of the round's depth among the first max_leaves - 1 pops; unknown children can
    only delay a node, so none that the true order splits is missed.  The last replay
    numbers the nodes in the order of their pops; ties go to the lower number.
    """
    front = _Frontier(config, cuts, selected)
    answer = yield from front.begin()
    known = dict(answer.splits) if config.max_depth else {}
    work, budget, depth_of = front.tree, config.max_leaves - 1 if config.max_leaves > 0 else 1 << 60, {0: 0}

    def replay() -> tuple[list[int], Tree, dict[int, int]]:
        """(nodes of ``work`` in the order they are split, the tree of that order, node of work of each of its nodes)."""
        out, of = Tree(), {0: 0}
        out.add(work.cover[0])
        heap = [(-known[0].gain, 0)] if 0 in known else []
        order: list[int] = []
        while heap and len(order) < budget:
            _, n = heapq.heappop(heap)
            w = of[n]
            order.append(w)
            s = known[w]
            kids = out.split(n, s.fid, s.bin, float(cuts[s.fid][s.bin]), s.default_left, s.gain, (float(s.left[2]), float(s.right[2])))
            for k, c in zip(kids, (work.left[w], work.right[w])):
                of[k] = c
                if c in known:
                    heapq.heappush(heap, (-known[c].gain, k))
        return order, out, of

    for depth in range(config.max_depth):
        todo = sorted(n for n in replay()[0] if depth_of[n] == depth and work.left[n] < 0)
        if not todo:
            break
        pairs = [front.split(n, known[n]) for n in todo]
        depth_of |= {k: depth + 1 for _, *kids in pairs for k in kids}
        if depth + 1 < config.max_depth:
            known |= (yield front.ask(pairs)).splits
    _, tree, of = replay()
    for n in tree.leaves:
        tree.value[n] = front.value(of[n])
    return tree


GROWERS: dict[str, Callable[..., Grower]] = {"depthwise": depthwise, "levelwise": levelwise, "leafwise": leafwise}
