"""Tables of blocks: a row holds some thousand rows' bins, labels, weights and scores as binary columns.

Blocks cross between Spark and Arrow by the buffer, not by the value, and are arrays without a copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.binning import Cuts, bins_of

#: Bytes of a block, and the most rows that it has.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 14
SCHEMA = "n int, rid binary, label binary, weight binary, bins binary, score binary"
NAMES = ["n", "rid", "label", "weight", "bins", "score"]


@dataclass(frozen=True)
class Block:
    rid: np.ndarray  # int64
    label: np.ndarray  # float32
    weight: np.ndarray | None  # float32, none where all are 1
    bins: np.ndarray  # [features, rows]
    score: np.ndarray  # [rows, classes], none before training

    def __len__(self) -> int:
        return len(self.rid)

    def with_score(self, score: np.ndarray) -> Block:
        return replace(self, score=score)


def bin_type(n_bins: np.ndarray) -> np.dtype:
    return np.dtype(np.uint8 if n_bins.max() <= 256 else np.uint16)


def read(batch: pa.RecordBatch, n_features: int, kind: np.dtype, n_classes: int = 0) -> Iterator[Block]:
    for i in range(batch.num_rows):
        get = lambda name, dtype: np.frombuffer(batch.column(name)[i].as_buffer() or b"", dtype)  # noqa: E731, B023
        n = batch.column("n")[i].as_py()
        weight = batch.column("weight")[i]
        yield Block(get("rid", np.int64), get("label", np.float32), np.frombuffer(weight.as_buffer(), np.float32) if weight.is_valid else None, get("bins", kind).reshape(n_features, n), get("score", np.float64).reshape(n, n_classes))


def write(b: Block) -> pa.RecordBatch:
    """A batch of one block."""
    def data(x: np.ndarray | None) -> pa.Array:
        if x is None:
            return pa.nulls(1, pa.binary())
        return pa.BinaryArray.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(np.ascontiguousarray(x).ravel())])

    return pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int32()), *[data(x) for x in (b.rid, b.label, b.weight, b.bins, b.score)]], NAMES)


def make(df: DataFrame, cuts: Cuts, weighted: bool) -> DataFrame:
    """Blocks of a table with columns rid, label, weight and f0, f1, ...; a partition's last block may be short."""
    shared, kind, width = df.sparkSession.sparkContext.broadcast(cuts.cuts), bin_type(cuts.n_bins), len(cuts.names)
    rows = int(np.clip(BLOCK_BYTES // (width * kind.itemsize + 24), 1024, BLOCK_ROWS))

    def block(table: pa.Table) -> pa.RecordBatch:
        get = lambda name: table[name].to_numpy()
        bins = np.empty((width, table.num_rows), kind)
        for i, c in enumerate(shared.value):
            bins[i] = bins_of(get(f"f{i}"), c)
        weight = get("weight") if weighted else None
        return write(Block(get("rid"), get("label"), weight, bins, np.zeros((table.num_rows, 0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, rows - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == rows:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return df.mapInArrow(run, SCHEMA)
