"""Models: ensembles with prediction, explanation, importance and storage."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Params
from ..functions import objectives
from ..operators.binning import Cuts
from ..operators.routing import leaf_of_bins, leaf_of_values, raw_goes_left
from . import shap
from .trees import TABLE, Tree

#: Up to so many leaves an ensemble is one generated expression; beyond, where compiled code outgrows a method, trees are walked over Arrow batches.
EXPRESSION_LEAVES = 64
FORMAT = {"magic": "coppice", "version": 2}


def _value_column(t: Tree, names: Sequence[str], pick, node: int = 0) -> Column:
    if t.fid[node] < 0:
        return pick(node)
    v = F.when(F.col(names[t.fid[node]]).cast("float") == float("inf"), F.lit(None)).otherwise(F.col(names[t.fid[node]]))
    return F.when(raw_goes_left(v, t.threshold[node], t.default_left[node]), _value_column(t, names, pick, t.left[node])).otherwise(_value_column(t, names, pick, t.right[node]))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@dataclass
class Model:
    """``trees`` of a multiclass model run by round, then class; leaves don't hold the learning rate."""

    config: Config
    cuts: Cuts
    init: list[float]
    trees: list[Tree] = field(default_factory=list)
    eval_history: list[float] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return list(self.cuts.names)

    @property
    def n_classes(self) -> int:
        return len(self.init)

    @property
    def n_iters(self) -> int:
        return len(self.trees) // self.n_classes

    @property
    def objective(self) -> objectives.Objective:
        return objectives.of(self.config)

    @property
    def rate(self) -> float:
        return self.config.booster.learning_rate

    def truncate(self, rounds: int) -> Model:
        return Model(self.config, self.cuts, self.init, self.trees[: rounds * self.n_classes], self.eval_history[:rounds])

    # Prediction -----------------------------------------------------------------------------

    def _used(self, num_iteration: int | None) -> list[Tree]:
        return self.trees if not num_iteration or num_iteration < 0 else self.trees[: num_iteration * self.n_classes]

    def raw(self, df: DataFrame, out: str = "raw", num_iteration: int | None = None, binned: bool = False) -> DataFrame:
        """Adds the raw score, an array of scores for several classes.

        ``binned``: the features are an array column ``bins`` under this model's cuts; scores equal those of the values.
        """
        trees, k = self._used(num_iteration), self.n_classes
        if not binned and sum(len(t.leaves) for t in trees) <= EXPRESSION_LEAVES:
            total = lambda ts: reduce(add, [_value_column(t, self.features, lambda n, t=t: F.lit(float(t.value[n]))) for t in ts], F.lit(0.0))
            scores = [F.lit(float(b)) + F.lit(self.rate) * total(trees[i::k]) for i, b in enumerate(self.init)]
            return df.withColumn(out, scores[0] if k == 1 else F.array(*scores))
        values, init, rate = [np.array(t.value) for t in trees], np.array(self.init), self.rate

        def finish(leaves: Iterator[np.ndarray], n: int) -> pa.Array:
            s = np.zeros((n, k))
            for i, leaf in enumerate(leaves):
                s[:, i % k] += values[i][leaf]
            return _lists(init + rate * s) if k > 1 else pa.array(init[0] + rate * s[:, 0])

        return self._walk(df, trees, out, "double" if k == 1 else "array<double>", finish, binned)

    def _walk(self, df: DataFrame, trees: list[Tree], out: str, kind: str, finish, binned: bool) -> DataFrame:
        """Adds what ``finish`` makes of each tree's leaves in turn, by Arrow batches."""
        leaves = self._leaves(df, trees, binned)

        def run(b: pa.RecordBatch, x: np.ndarray) -> pa.Array:
            return finish(leaves(x), b.num_rows)

        return self._by_batch(df, out, kind, run, binned)

    def _leaves(self, df: DataFrame, trees: list[Tree], binned: bool):
        shared, last = df.sparkSession.sparkContext.broadcast([t.arrays() for t in trees]), self.cuts.n_bins - 1
        return lambda x: ((leaf_of_bins(t, x.T, last) if binned else leaf_of_values(t, x)) for t in shared.value)

    def _by_batch(self, df: DataFrame, out: str, kind: str, make, binned: bool) -> DataFrame:
        """Adds the column that ``make`` makes of a batch and its features [rows, features]; a column of that name goes."""
        source = fresh(df, "features")
        x = F.col("bins") if binned else F.array(*[F.col(n).cast("float") for n in self.features])
        before, width = [c for c in df.columns if c.lower() != out.lower()], len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    features = b.column(source).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in before], make(b, features)], [*before, out])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in before)
        return df.withColumn(source, x).mapInArrow(run, f"{schema}, `{out}` {kind}" if schema else f"`{out}` {kind}")

    def _linked(self, df: DataFrame, out: str, link, num_iteration: int | None, binned: bool) -> DataFrame:
        raw = fresh(df, "raw")
        return self.raw(df, raw, num_iteration, binned).withColumn(out, link(F.col(raw))).drop(raw)

    def predict(self, df: DataFrame, out: str = "prediction", num_iteration: int | None = None, binned: bool = False) -> DataFrame:
        """Adds the prediction: the linked score, or the class with the highest score (ties: the lowest)."""
        return self._linked(df, out, best_class if self.n_classes > 1 else self.objective.link, num_iteration, binned)

    def predict_proba(self, df: DataFrame, out: str = "probability", num_iteration: int | None = None, binned: bool = False) -> DataFrame:
        """Adds P(1), or an array of class probabilities."""
        if self.objective.task == "regression":
            raise ValueError("a regression model has no probabilities")
        return self._linked(df, out, objectives.softmax if self.n_classes > 1 else objectives.sigmoid, num_iteration, binned)

    def predict_leaf(self, df: DataFrame, out: str = "leaf", binned: bool = False) -> DataFrame:
        """Adds an array of the leaf's node number in every tree."""
        if not binned and sum(len(t.leaves) for t in self.trees) <= EXPRESSION_LEAVES:
            return df.withColumn(out, F.array(*[_value_column(t, self.features, lambda n: F.lit(n)) for t in self.trees]).cast("array<int>"))
        return self._walk(df, self.trees, out, "array<int>", lambda leaves, n: _lists(np.array(list(leaves), np.int32).reshape(-1, n).T), binned)

    def predict_staged(self, df: DataFrame, row_id: str, out: str = "raw", binned: bool = False) -> DataFrame:
        """(row_id, iteration, raw) after each round: a running sum over the row's trees, in one walk."""
        if self.n_classes > 1:
            raise ValueError("staged predictions are of single scores")
        values, init, rate, stages = [np.array(t.value) for t in self.trees], self.init[0], self.rate, fresh(df, "stages")

        def finish(leaves: Iterator[np.ndarray], n: int) -> pa.Array:
            each = np.zeros((n, len(values)))
            for i, leaf in enumerate(leaves):
                each[:, i] = values[i][leaf]
            return _lists(init + rate * each.cumsum(1))

        got = self._walk(df.select(F.col(row_id), *([F.col("bins")] if binned else [F.col(c) for c in self.features if c != row_id])), self.trees, stages, "array<double>", finish, binned)
        return got.select(row_id, F.posexplode(stages).alias("iteration", out)).withColumn("iteration", F.col("iteration") + 1)

    # Explanation ----------------------------------------------------------------------------

    def contributions(self, df: DataFrame, out: str = "contributions", binned: bool = False) -> DataFrame:
        """Adds exact path-dependent Shapley values and, last, the expectation; they sum to the raw score.

        Several classes give their values one after another, class by class.
        """
        k, width = self.n_classes, len(self.features)
        packs = [shap.pack(self.trees[i::k], self.cuts.n_bins - 1 if binned else None) for i in range(k)]
        bias = [b + self.rate * sum(t.expected() for t in self.trees[i::k]) for i, b in enumerate(self.init)]
        shared, rate = df.sparkSession.sparkContext.broadcast(packs), self.rate

        known: list = []

        def make(b: pa.RecordBatch, x: np.ndarray) -> pa.Array:
            parts = []
            if not known:
                known.extend(shap.tables(p) for p in shared.value)
            for at in range(0, len(x), 4096):
                some = x[at : at + 4096]
                parts.append(np.concatenate([y for p, t, c in zip(shared.value, known, bias) for y in (rate * shap.evaluate(p, some, width, t), np.full((len(some), 1), c))], 1))
            return _lists(np.concatenate(parts))

        return self._by_batch(df, out, "array<double>", make, binned)

    def tree_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r for i, t in enumerate(self.trees) for r in t.rows(i)], TABLE)

    def importance(self, kind: str = "gain") -> list[float]:
        """Per feature, padded with zeros: the gains of its splits, or their number."""
        if kind not in ("gain", "split"):
            raise ValueError("importance is by gain or split")
        out = [0.0] * len(self.features)
        for t in self.trees:
            nodes = t.levels or [i for i, f in enumerate(t.fid) if f >= 0]
            for i in nodes:
                out[t.fid[i]] += t.gain[i] if kind == "gain" else 1
        return out

    def dump(self) -> str:
        """The trees as indented text."""
        lines = []
        for i, t in enumerate(self.trees):
            lines.append(f"tree {i}:" if self.n_classes == 1 else f"tree {i // self.n_classes} class {i % self.n_classes}:")
            if t.levels:
                for d, n in enumerate(t.levels):
                    lines.append(f"level {d}: {self.features[t.fid[n]]} <= {t.threshold[n]:.6f} [nan->{'left' if t.default_left[n] else 'right'}] gain={t.gain[n]:.6f}")
                ends = [n for n, _ in t.paths()]
                lines += ["leaves: " + " ".join(f"{t.value[n]:.6f}" for n in ends), "covers: " + " ".join(f"{t.cover[n]:.0f}" for n in ends)]
                continue
            todo = [(0, 1)]
            while todo:
                n, deep = todo.pop()
                if t.fid[n] < 0:
                    lines.append("  " * deep + f"leaf={t.value[n]:.6f} cover={t.cover[n]:.0f}")
                else:
                    lines.append("  " * deep + f"{self.features[t.fid[n]]} <= {t.threshold[n]:.6f} [nan->{'left' if t.default_left[n] else 'right'}] gain={t.gain[n]:.6f} cover={t.cover[n]:.0f}")
                    todo += [(t.right[n], deep + 1), (t.left[n], deep + 1)]
        return "\n".join(lines) + ("\n" if lines else "")

    # Storage --------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """A folder in any store that Spark writes to: model.json, and the trees as a Parquet table."""
        spark = _session()
        body = FORMAT | {"config": self.config.to_dict(), "names": self.features, "cuts": [[_number(x) for x in c] for c in self.cuts.cuts], "init": self.init, "history": [_number(x) for x in self.eval_history], "levels": [t.levels for t in self.trees]}
        bins = [(i, n, at) for i, t in enumerate(self.trees) for n, at in enumerate(t.bin)]
        table = self.tree_table(spark).join(spark.createDataFrame(bins, "tree int, node int, bin int"), ["tree", "node"])
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/model.json")
        out = at.getFileSystem(conf).create(at, True)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()

    @classmethod
    def load(cls, path: str) -> Model:
        spark = _session()
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/model.json")
        if not at.getFileSystem(conf).exists(at):
            raise ValueError(f"{path} holds no model")
        try:
            body = json.loads(spark.read.text(f"{path}/model.json", wholetext=True).first()[0])
        except ValueError as e:
            raise ValueError(f"{path} holds no model") from e
        if not isinstance(body, dict) or body.get("magic") != FORMAT["magic"]:
            raise ValueError(f"{path} holds no model")
        if body["version"] != FORMAT["version"]:
            raise ValueError(f"{path} has version {body['version']}; this is {FORMAT['version']}")
        trees = [Tree(levels=list(x)) for x in body["levels"]]
        for r in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():
            t = trees[r["tree"]]
            for name in ("fid", "bin", "threshold", "left", "right", "default_left", "value", "gain", "cover"):
                getattr(t, name).append(r[name])
        cuts = Cuts(tuple(body["names"]), tuple(np.array([float(x) for x in c], np.float32) for c in body["cuts"]))
        return cls(Params(body["config"]).config(), cuts, body["init"], trees, [float(x) for x in body["history"]])


def best_class(scores: Column) -> Column:
    """The place of the highest score, the lowest on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of an array as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _number(x: float) -> float | str:
    return float(x) if np.isfinite(x) else str(float(x))
