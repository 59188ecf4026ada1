"""Split search for growing trees: one job sums the cells of all nodes that are asked for.

While a level's cells fit on the driver, siblings are the difference of parent and child and splits
are found there; cells are dropped with their node.  Beyond, every node's cells are summed and searched
on the executors, a tile of features at a time, and only the best split of each tile comes back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Tree as TreeConfig
from ..operators import histogram as H
from ..operators import split as S
from ..operators.routing import leaf_of_bins
from .blocks import Block
from .growers import Answer, Ask

#: Cells of a level that the driver may hold, of a tile, and bytes of partial sums that it takes from the partitions directly.
DRIVER_CELLS, TILE_CELLS, DIRECT_BYTES = 8_000_000, 1 << 16, 64 << 20

#: Gradients, hessians (none: all 1) and rows (none: all) of a block, by class.
Prepared = list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]


@dataclass
class Build:
    """Nodes of class k's tree whose cells are summed, in this order."""

    k: int
    tree: dict[str, np.ndarray]
    nodes: list[int]


class Search:
    """Answers the asks of one round's trees, one a class, from ``active`` blocks."""

    def __init__(self, active: DataFrame, blocks: Callable[[pa.RecordBatch], Iterator[Block]], prepare: Callable[[Block], Prepared], config: TreeConfig, n_bins: np.ndarray, selected: list[np.ndarray], n_parts: int, driver_cells: int = DRIVER_CELLS):
        self.active, self.blocks, self.prepare, self.config, self.n_bins, self.n_parts, self.driver_cells = active, blocks, prepare, config, n_bins, n_parts, driver_cells
        self.width, self.features = int(n_bins.max()), np.flatnonzero(np.any(selected, axis=0))
        self.sign = np.array([*config.monotone_constraints, *[0] * len(n_bins)][: len(n_bins)])
        self.held: list[dict[int, np.ndarray]] = [{} for _ in selected]

    def answer(self, asks: dict[int, Ask]) -> dict[int, Answer]:
        level = sum(max(1, 2 * len(a.pairs)) for a in asks.values()) * len(self.features) * self.width
        roots = all(not a.pairs for a in asks.values())
        if level <= self.driver_cells and (roots or all(p in self.held[k] for k, a in asks.items() for p, *_ in a.pairs)):
            return self._here(asks)
        self.held = [{} for _ in self.held]
        return self._there(asks)

    # Cells on the driver --------------------------------------------------------------------

    def _here(self, asks: dict[int, Ask]) -> dict[int, Answer]:
        cover = {k: a.tree.cover for k, a in asks.items()}
        small = {k: [left if cover[k][left] <= cover[k][right] else right for _, left, right in a.pairs] or [0] for k, a in asks.items()}
        built = self.cells([Build(k, a.tree.arrays(), small[k]) for k, a in sorted(asks.items())])
        out = {}
        for k, ask in asks.items():
            held, fresh = self.held[k], built[k]
            for (parent, left, right), s in zip(ask.pairs, small[k]):
                fresh[right if s == left else left] = H.subtract(held[parent], fresh[s])
            self.held[k] = fresh
            own = [self._own(ask.limits[n]) for n in sorted(ask.limits)]
            if ask.level:
                found = S.find_level([fresh[n] for n in sorted(fresh)], self.n_bins[self.features], self.config, own[0][0])
                splits = dict(zip(sorted(fresh), found or []))
            else:
                sign = self.sign[self.features]
                splits = {n: s for n, x in zip(sorted(ask.limits), own) if (s := S.find(fresh[n], self.n_bins[self.features], self.config, *x, sign))}
            for s in splits.values():
                s.fid = int(self.features[s.fid])
            out[k] = Answer(splits, (0.0, 0.0, 0) if ask.pairs else H.totals(fresh[0]))
        return out

    def _own(self, limits):
        mask, lo, hi = limits
        return mask[self.features], lo, hi

    def cells(self, builds: list[Build]) -> dict[int, dict[int, np.ndarray]]:
        """{class: {node: cells [searched features, bins, 3]}}."""
        n = sum(len(b.nodes) for b in builds)
        f, w = len(self.features), self.width
        tile = f if self.n_parts * n * f * w * 24 <= DIRECT_BYTES else max(1, TILE_CELLS // (n * w))
        parts = self.active.mapInArrow(self._summer(builds, tile), "tile int, part int, data binary")
        if tile < f:
            parts = self._merged(parts)
        whole = np.zeros((f, n, w, 3))
        for r in sorted(parts.collect(), key=lambda r: (r["tile"], r["part"])):
            x = np.frombuffer(r["data"]).reshape(3, -1, n, w)
            whole[r["tile"] * tile :][: x.shape[1]] += np.moveaxis(x, 0, -1)
        out, at = {}, 0
        for b in builds:
            out[b.k] = {node: np.ascontiguousarray(whole[:, at + i]) for i, node in enumerate(b.nodes)}
            at += len(b.nodes)
        return out

    def _summer(self, builds: list[Build], tile: int):
        """Sums a partition's rows by tile: rows (tile, part, data [3, features, slots * bins])."""
        blocks, prepare, features, width, last = self.blocks, self.prepare, self.features, self.width, self.n_bins - 1
        total = sum(len(b.nodes) for b in builds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work, unit = [], True
            for batch in batches:
                for x in blocks(batch):
                    prepared, at = prepare(x), 0
                    for b in builds:
                        g, h, rows = prepared[b.k]
                        slot = np.full(len(b.tree["fid"]), -1, np.int32)
                        slot[b.nodes] = np.arange(at, at + len(b.nodes))
                        at += len(b.nodes)
                        own = slot[leaf_of_bins(b.tree, x.bins, last)]
                        keep = np.flatnonzero(own >= 0) if rows is None else rows[own[rows] >= 0]
                        if not len(keep):
                            continue
                        unit &= h is None
                        if len(keep) == len(x):
                            work.append((x.bins, own, None, g, h))
                        else:
                            work.append((x.bins, own[keep], keep, g[keep], None if h is None else h[keep]))
            if not work:
                return
            part = TaskContext.get().partitionId()
            for t, i in enumerate(range(0, len(features), tile)):
                some = features[i : i + tile]
                out = np.zeros((3, len(some), total * width))
                for bins, slot, rows, g, h in work:
                    H.add(out, bins, some, width, slot, rows, g, h if unit or h is not None else np.ones(len(g)))
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([part], pa.int32()), pa.array([H.finish(out, unit).tobytes()], pa.binary())], ["tile", "part", "data"])

        return run

    def _merged(self, parts: DataFrame) -> DataFrame:
        """Partial sums of each tile added up by groups of 64 partitions, so that no task holds more of them."""

        def add(table: pa.Table) -> pa.Table:
            order = np.argsort(table["part"].to_numpy())
            data = table["data"].combine_chunks()
            total = sum(np.frombuffer(data[int(i)].as_buffer()) for i in order)
            return pa.table({"tile": pa.array([table["tile"][0].as_py()], pa.int32()), "part": pa.array([table["part"][int(order[0])].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

        return parts.groupBy("tile", (F.col("part") / 64).cast("int").alias("g")).applyInArrow(add, "tile int, part int, data binary")

    # Cells on the executors -----------------------------------------------------------------

    def _there(self, asks: dict[int, Ask]) -> dict[int, Answer]:
        builds = [Build(k, a.tree.arrays(), sorted(a.limits)) for k, a in sorted(asks.items())]
        n, w = sum(len(b.nodes) for b in builds), self.width
        tile = max(1, TILE_CELLS // (n * w))
        parts = self._merged(self.active.mapInArrow(self._summer(builds, tile), "tile int, part int, data binary"))
        features, n_bins, config, sign = self.features, self.n_bins, self.config, self.sign
        shared = self.active.sparkSession.sparkContext.broadcast([(b.k, b.nodes, [asks[b.k].limits[x] for x in b.nodes], asks[b.k].level) for b in builds])
        names = ["k", "node", "fid", "bin", "default_left", "gain", "left", "right", "total"]

        def best(table: pa.Table) -> pa.Table:
            t = table["tile"][0].as_py()
            some = features[t * tile : (t + 1) * tile]
            x = sum(np.frombuffer(d.as_buffer()) for d in table["data"].combine_chunks()).reshape(3, len(some), n, w)
            cells, rows, at = np.moveaxis(x, 0, -1), [], 0
            for k, nodes, limits, level in shared.value:
                own = [np.ascontiguousarray(cells[:, at + i]) for i in range(len(nodes))]
                at += len(nodes)
                if level:
                    found = S.find_level(own, n_bins[some], config, limits[0][0][some]) or [None] * len(nodes)
                else:
                    found = [S.find(c, n_bins[some], config, mask[some], lo, hi, sign[some]) for c, (mask, lo, hi) in zip(own, limits)]
                for node, c, s in zip(nodes, own, found):
                    head = (k, node, int(some[s.fid]), s.bin, s.default_left, s.gain, list(map(float, s.left)), list(map(float, s.right))) if s else (k, node, -1, -1, False, 0.0, None, None)
                    rows.append((*head, list(map(float, H.totals(c)))))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

        got = parts.groupBy("tile").applyInArrow(best, "k int, node int, fid int, bin int, default_left boolean, gain double, left array<double>, right array<double>, total array<double>")
        top = F.min_by(F.struct(*names), F.struct(F.when(F.col("fid") < 0, 1).otherwise(0), -F.col("gain"), "fid"))
        out = {k: Answer() for k in asks}
        sums = lambda x: (x[0], x[1], int(round(x[2])))
        for r in got.groupBy("k", "node").agg(top.alias("s")).collect():
            s = r["s"]
            if s["fid"] >= 0:
                out[r["k"]].splits[r["node"]] = S.Split(s["gain"], s["fid"], s["bin"], s["default_left"], sums(s["left"]), sums(s["right"]))
            if not asks[r["k"]].pairs:
                out[r["k"]].total = sums(s["total"])
        return out
