"""Binned training tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BinMapper
from ..functions.ranking import whole_id
from ..operators.binning import Cuts, fit_cuts
from . import blocks


class BinnedDataset:
    """A table's bins, labels and weights as blocks, kept in memory and on disk.

    ``row_id`` names a column that tells rows apart for sampling: whole numbers, or anything that is hashed;
    without it a hash of the row does.  ``reference`` lends its cuts.  Null features are missing values.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, row_id: str | None = None, max_bin: int | None = None, n_samples: int | None = None, seed: int | None = None, min_data_in_bin: int | None = None, bin_edges=None, reference: BinnedDataset | None = None, cuts: Cuts | None = None, config: BinMapper | None = None):
        if len(set(features)) != len(features) or not features:
            raise ValueError("feature names must be given and unique")
        missing = [c for c in (*features, label, *([weight] if weight else []), *([row_id] if row_id else [])) if c not in df.columns]
        if missing:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        base = config or BinMapper()
        self.config = BinMapper(max_bin or base.max_bin, base.n_samples if n_samples is None else n_samples, base.seed if seed is None else seed, min_data_in_bin or base.min_data_in_bin)
        if not 3 <= self.config.max_bin <= 65_535:
            raise ValueError("max_bin must be between 3 and 65535")
        if reference is not None:
            own = {"bin_edges": bin_edges, "max_bin": max_bin, "n_samples": n_samples, "seed": seed, "min_data_in_bin": min_data_in_bin}
            given = [k for k, v in own.items() if v is not None]
            if given:
                raise ValueError(f"a dataset with a reference takes its cuts, without {', '.join(given)}")
            if len(reference.cuts.cuts) != len(features):
                raise ValueError("the reference has another number of features")
            cuts = Cuts(tuple(features), reference.cuts.cuts)
            self.config = reference.config
        self.features, self.label, self.weighted = list(features), label, weight is not None
        self.cuts = cuts or fit_cuts(df, self.features, self.config, row_id, bin_edges)
        rid = F.coalesce(whole_id(df, row_id), F.lit(0).cast("long")) if row_id else F.xxhash64(*features, label)
        number = lambda c: F.col(c).cast("float")
        cols = [rid.alias("rid"), number(label).alias("label"), (number(weight) if weight else F.lit(1.0).cast("float")).alias("weight"), *[number(f).alias(f"f{i}") for i, f in enumerate(self.features)]]
        made = blocks.make(df.select(cols), self.cuts, self.weighted)
        slots = df.sparkSession.sparkContext.defaultParallelism
        if made.rdd.getNumPartitions() < slots:  # a small table in few files: its blocks are dealt to all cores
            made = made.repartition(slots)
        self.blocks = made.persist(StorageLevel.MEMORY_AND_DISK)

    def unpersist(self) -> None:
        self.blocks.unpersist()
