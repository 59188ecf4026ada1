"""The boosting loop: the driver keeps trees and frontiers, Spark keeps blocks of rows with bins and scores.

A level is one job: rows are routed through the tree so far, their gradients are
summed by node, feature and bin, and only those sums come back.
"""

from __future__ import annotations

import logging
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, as_config, by_position, given_keys
from ..functions import objectives
from ..functions.ranking import remove, select, sortable, unsorted, written
from ..operators.routing import leaf_of_bins
from ..operators.samplers import OneSide, bernoulli, feature_subset
from . import blocks as B
from .dataset import BinnedDataset
from .growers import GROWERS, Ask
from .model import Model
from .search import Prepared, Search
from .trees import Tree

log = logging.getLogger("coppice")

#: Rounds between tables of the scores: bounds the lineage a lost executor makes Spark repeat.
TABLE_ROUNDS = 10
Reader = Callable[[pa.RecordBatch], Iterator[B.Block]]


def grow(search: Search, config: Config, cuts: Sequence[np.ndarray], selected: list[np.ndarray]) -> list[Tree]:
    """One tree a class, all grown in step: each round of asks is one job."""
    runs = [GROWERS[config.grower](config.tree, list(cuts), s) for s in selected]
    trees: list[Tree | None] = [None] * len(runs)
    asks: dict[int, Ask] = {}

    def advance(k: int, answer) -> None:
        try:
            asks[k] = runs[k].send(answer)
        except StopIteration as done:
            trees[k] = done.value
            asks.pop(k, None)

    for k in range(len(runs)):
        advance(k, None)
    while asks:
        for k, answer in search.answer(dict(asks)).items():
            advance(k, answer)
    return [t for t in trees if t is not None]


def gradients(b: B.Block, objective: objectives.Objective) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Gradients and hessians times the weight, by class; no hessians where all are 1."""
    y, k = b.label.astype(np.float64), objective.n_classes
    g, h = objective.grad_hess(b.score if k > 1 else b.score[:, 0], y)
    if b.weight is not None:
        w = b.weight.astype(np.float64)
        g, h = (x * (w[:, None] if k > 1 else w) for x in (g, h))
    if k > 1:
        return [(g[:, c], h[:, c]) for c in range(k)]
    return [(g, None if objective.unit_hessian and b.weight is None else h)]


def sampler(state: DataFrame, read: Reader, config: Config, objective: objectives.Objective, seed: int, n_rows: int) -> Callable[[B.Block], Prepared]:
    """Gradients of a block, the rows that are drawn, and those made up for that stand for others."""
    name, s, k = config.dispatch.sampler_name, config.sampler, objective.n_classes
    if name == "bernoulli" and s.subsample < 1:
        return lambda b: [(g, h, np.flatnonzero(bernoulli(b.rid, s.subsample, seed + c))) for c, (g, h) in enumerate(gradients(b, objective))]
    if name != "goss":
        return lambda b: [(g, h, None) for g, h in gradients(b, objective)]

    def rows(c: int):
        def emit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            parts = [(gradients(b, objective)[c][0], b.rid) for b in read(batch)]
            return tuple(np.concatenate(x) for x in zip(*parts))

        return emit

    sides = [OneSide.fit(state, rows(c), s, seed + c, n_rows) for c in range(k)]

    def prepare(b: B.Block) -> Prepared:
        out = []
        for (g, h), side in zip(gradients(b, objective), sides):
            if side is None:
                out.append((g, h, None))
                continue
            w = side.weights(g, b.rid)
            out.append((g * w, w if h is None else h * w, np.flatnonzero(w)))
        return out

    return prepare


def _mapped(state: DataFrame, read: Reader, change: Callable[[B.Block], B.Block]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in read(batch):
                yield B.write(change(b))

    return state.mapInArrow(run, B.SCHEMA)


def _adding(parts: list[tuple[int, Tree, float]], last: np.ndarray) -> Callable[[B.Block], B.Block]:
    """score[k] += factor * value of the row's leaf, for each (k, tree, factor)."""
    arrays = [(k, t.arrays(), x) for k, t, x in parts]

    def add(b: B.Block) -> B.Block:
        score = b.score.copy()
        for k, t, x in arrays:
            score[:, k] += x * t["value"][leaf_of_bins(t, b.bins, last)]
        return b.with_score(score)

    return add


def renewed(rows: DataFrame, emit, objective: objectives.Objective, leaves: Sequence[int]) -> dict[int, float]:
    """The leaf values that minimise the loss over all rows' residuals, without weights; ``emit`` makes leaves and residuals of a batch."""
    alpha = objective.alpha if objective.name == "quantile" else 0.5
    place = np.full(max(leaves) + 1, -1)
    place[list(leaves)] = np.arange(len(leaves))

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        leaf, r = emit(b)
        return place[leaf], sortable(r)

    sizes: list[np.ndarray] = []

    def rank(size: np.ndarray) -> np.ndarray:
        sizes.append(size)
        return np.minimum(np.floor(alpha * np.maximum(size - 1, 0) + 0.5), np.maximum(size - 1, 0))

    key, *_ = select(rows, keys, rank, len(leaves))
    q = unsorted(key)
    if objective.name == "huber":

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(leaves))
            for b in batches:
                leaf, r = emit(b)
                at = place[leaf]
                total += np.bincount(at, np.clip(r - q[at], -objective.delta, objective.delta), len(leaves))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(leaves))), pa.array(total)], ["leaf", "s"])

        got = rows.mapInArrow(near, "leaf long, s double").groupBy("leaf").agg(F.sum("s").alias("s")).toArrow()
        total = np.zeros(len(leaves))
        total[got["leaf"].to_numpy()] = got["s"].to_numpy()
        q = q + total / np.maximum(sizes[0], 1)
    return {leaf: float(x) for leaf, x, n in zip(leaves, q, sizes[0]) if n}


def dart_scales(k: int, rate: float) -> tuple[float, float]:
    """Factors of the new tree and of each of the k dropped ones."""
    return 1.0 / (k + rate), k / (k + rate)


class Patience:
    """Early stopping: a round is better if it is the first or its loss strictly less."""

    def __init__(self, rounds: int):
        self.rounds, self.best, self.at, self.seen = rounds, float("inf"), -1, -1

    def stop(self, loss: float) -> bool:
        """Takes the next round's loss; True once ``rounds`` rounds (if any) have not been better."""
        self.seen += 1
        if self.at < 0 or loss < self.best:
            self.best, self.at = loss, self.seen
        return bool(self.rounds) and self.seen - self.at >= self.rounds


class _Scores:
    """Blocks with their running scores: kept in memory and on disk, and written to a table now and then."""

    def __init__(self, ds: BinnedDataset, start: list[float], trees: list[Tree], rate: float):
        n_bins, k = ds.cuts.n_bins, len(start)
        self.last, self.k, self.steps, self.path, self.before = n_bins - 1, k, 0, None, None
        kind, width = B.bin_type(n_bins), len(n_bins)
        self.read: Reader = lambda batch: B.read(batch, width, kind, k)
        replay = _adding([(i % k, t, rate) for i, t in enumerate(trees)], self.last)
        begin = np.array(start)
        unscored: Reader = lambda batch: B.read(batch, width, kind)
        self.df = _mapped(ds.blocks, unscored, lambda b: replay(b.with_score(np.repeat(begin[None, :], len(b), 0)))).persist(StorageLevel.MEMORY_AND_DISK)

    def add(self, parts: list[tuple[int, Tree, float]]) -> None:
        """The next job that reads the scores also makes them; what they come from is let go one step later."""
        if self.before is not None:
            self.before.unpersist()
        after, self.steps = _mapped(self.df, self.read, _adding(parts, self.last)), self.steps + 1
        self.before = self.df
        if self.steps % TABLE_ROUNDS:
            self.df = after.persist(StorageLevel.MEMORY_AND_DISK)
            return
        old, (table, self.path) = self.path, written(after)
        self.df = table.persist(StorageLevel.MEMORY_AND_DISK)
        if old:
            remove(self.df.sparkSession, old)

    def loss(self, objective: objectives.Objective) -> float:
        read = self.read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = [objective.loss(b.score if objective.n_classes > 1 else b.score[:, 0], b.label.astype(np.float64)) for b in read(batch)]
                if each:
                    yield pa.RecordBatch.from_arrays([pa.array([float(sum(x.sum() for x in each))]), pa.array([sum(map(len, each))])], ["s", "n"])

        total, n = self.df.mapInArrow(run, "s double, n long").agg(F.sum("s"), F.sum("n")).first()
        return float(total / n)

    def close(self) -> None:
        for df in (self.before, self.df):
            if df is not None:
                df.unpersist()
        if self.path:
            remove(self.df.sparkSession, self.path)


def labels(ds: BinnedDataset) -> DataFrame:
    """(label, part) of every row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("label"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.float32))], ["label"])

    return ds.blocks.mapInArrow(run, "label float").withColumn("part", F.spark_partition_id())


def _residuals(tree: Tree, read: Reader, last: np.ndarray):
    """(leaf, label - score) of a batch's rows."""
    t = tree.arrays()

    def emit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        parts = [(leaf_of_bins(t, b.bins, last), b.label.astype(np.float64) - b.score[:, 0]) for b in read(batch)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    return emit


def train(params, data: BinnedDataset | DataFrame, features: Sequence[str] | None = None, label: str | None = None, weight: str | None = None, row_id: str | None = None, eval_set: BinnedDataset | DataFrame | None = None, init_model: Model | None = None, on_round: Callable[[int, float | None], None] | None = None, bin_edges=None) -> Model:
    """Boosts ``booster.n_iters`` rounds on a table or a binned dataset.

    Rows with a null label are an error.  ``tree.monotone_constraints`` may map names to signs.  With ``init_model`` its cuts are used, its trees
    replayed and more added.  An evaluation set is scored each round; early stopping keeps
    the rounds up to the best.
    """
    names = data.features if isinstance(data, BinnedDataset) else list(features or [])
    config = as_config(by_position(params, names)).check()
    b = config.booster
    made: list[BinnedDataset] = []
    if isinstance(data, BinnedDataset):
        ds = data
        if init_model is not None and not ds.cuts.same(init_model.cuts):
            raise ValueError("the dataset's cuts are not the initial model's")
        asked = set(given_keys(by_position(params, names))) if not isinstance(params, Config) else {k for k, v in config.to_dict().items() if v != Config().to_dict()[k]}
        if odd := sorted(k for k in asked if k.startswith("bin_mapper.") and config.to_dict()[k] != getattr(ds.config, k.split(".")[1])):
            raise ValueError(f"the dataset is binned already: {', '.join(odd)} would have no effect")
        config.bin_mapper = ds.config
    else:
        if not features or label is None:
            raise ValueError("features and a label are needed")
        ds = BinnedDataset(data, features, label, weight, row_id, config=config.bin_mapper, cuts=init_model.cuts if init_model else None, bin_edges=bin_edges)
        made.append(ds)
    if init_model is not None and (init_model.config.dispatch.objective_name != config.dispatch.objective_name or len(init_model.features) != len(ds.features)):
        raise ValueError("the initial model has another objective or width")
    if len(config.tree.monotone_constraints) > len(ds.features):
        raise ValueError("more monotone constraints than features")
    if b.early_stopping_rounds and eval_set is None:
        raise ValueError("early stopping needs an evaluation set")
    if b.dart_drop_rate > 0 and eval_set is not None:
        raise ValueError("dropped trees and an evaluation set don't go together")
    if eval_set is not None and not isinstance(eval_set, BinnedDataset):
        eval_set = BinnedDataset(eval_set, ds.features, ds.label, None, row_id if row_id in eval_set.columns else None, cuts=ds.cuts, config=config.bin_mapper)
        made.append(eval_set)
    if eval_set is not None and not eval_set.cuts.same(ds.cuts):
        raise ValueError("the evaluation set has other cuts")
    if eval_set is not None and eval_set.weighted:
        raise ValueError("an evaluation set takes no weights")
    objective = objectives.of(config)
    k = objective.n_classes
    own = labels(ds)
    n_rows, bad, n_parts = own.agg(F.count("*"), F.sum((F.col("label").isNull() | F.isnan("label")).cast("int")), F.count_distinct("part")).first()
    if not n_rows:
        raise ValueError("no rows to train on")
    if bad:
        raise ValueError("labels must not be missing")
    start = init_model.init if init_model else objectives.softmax_init(own, k) if k > 1 else [objective.init_score(own)]
    trees = [Tree(**{n: list(x) for n, x in vars(t).items()}) for t in init_model.trees] if init_model else []
    warm = len(trees) // k
    n_bins = ds.cuts.n_bins
    rng = random.Random(b.random_seed)
    scores = _Scores(ds, start, trees, b.learning_rate)
    valid = None
    if eval_set is not None:
        if not eval_set.blocks.limit(1).count():
            raise ValueError("the evaluation set is empty")
        valid = _Scores(eval_set, start, trees, b.learning_rate)
    history = [float("nan")] * warm if valid else []
    patience = Patience(b.early_stopping_rounds)
    try:
        for i in range(b.n_iters):
            dart = b.dart_drop_rate > 0 and k == 1
            dropped = [j for j in range(len(trees)) if rng.random() < b.dart_drop_rate] if dart and trees else []
            base = _mapped(scores.df, scores.read, _adding([(0, trees[j], -b.learning_rate) for j in dropped], scores.last)).persist(StorageLevel.MEMORY_AND_DISK) if dropped else scores.df
            chosen = []
            for c in range(k):
                sel = np.zeros(len(ds.features), bool)
                sel[feature_subset(len(ds.features), config.tree.feature_fraction, config.tree.feature_seed + (warm + i) * k + c)] = True
                chosen.append(sel)
            prepare = sampler(base, scores.read, config, objective, rng.randrange(1 << 20), n_rows)
            new = grow(Search(base, scores.read, prepare, config.tree, n_bins, chosen, n_parts), config, ds.cuts.cuts, chosen)
            if objective.renews:
                values = renewed(base, _residuals(new[0], scores.read, scores.last), objective, new[0].leaves)
                for leaf in new[0].leaves:
                    new[0].value[leaf] = values.get(leaf, new[0].value[leaf])
            rate = b.learning_rate
            if dropped:
                fresh, old = dart_scales(len(dropped), rate)
                parts = []
                for j in dropped:
                    parts.append((0, Tree(**{n: list(x) for n, x in vars(trees[j]).items()}), -rate))
                    trees[j].value = [v * old for v in trees[j].value]
                    parts.append((0, trees[j], rate))
                new[0].value = [v * fresh for v in new[0].value]
                parts.append((0, new[0], rate))
                base.unpersist()
            else:
                parts = [(c, t, rate) for c, t in enumerate(new)]
            trees += new
            if i + 1 < b.n_iters:
                scores.add(parts)
            loss = None
            if valid:
                valid.add(parts)
                loss = valid.loss(objective)
                history.append(loss)
            if on_round:
                on_round(i, loss)
            if b.log_intervals and (i + 1) % b.log_intervals == 0:
                log.info("round %d of %d, loss %s", i + 1, b.n_iters, loss)
            if valid and patience.stop(loss):
                break
    finally:
        scores.close()
        if valid:
            valid.close()
        for d in made:
            d.unpersist()
    model = Model(config, ds.cuts, start, trees, history)
    return model.truncate(warm + patience.at + 1) if valid and b.early_stopping_rounds else model
