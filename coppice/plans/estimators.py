"""``pyspark.ml`` estimators: parameters, pipelines, cross-validation and persistence as for any other stage."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model as Fitted
from pyspark.ml.param import Param, Params as MLParams, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions import metrics as M
from .booster import train
from .model import Model, fresh


def _param(name: str, doc: str, kind=None) -> Param:
    return Param(MLParams._dummy(), name, doc, typeConverter=kind)


class _Settings(HasInputCols, HasLabelCol, HasWeightCol, HasPredictionCol):
    """What fits and fitted models share."""

    n_iters = _param("n_iters", "rounds", TypeConverters.toInt)
    learning_rate = _param("learning_rate", "factor of each tree", TypeConverters.toFloat)
    max_depth = _param("max_depth", "levels of a tree", TypeConverters.toInt)
    max_leaves = _param("max_leaves", "leaves of a leafwise tree, 0 for no bound", TypeConverters.toInt)
    grower = _param("grower", "depthwise, levelwise or leafwise", TypeConverters.toString)
    sampler = _param("sampler", "all_rows, bernoulli or goss", TypeConverters.toString)
    early_stopping_rounds = _param("early_stopping_rounds", "rounds without a better loss, 0 for none", TypeConverters.toInt)
    random_seed = _param("random_seed", "seed of samplers and drops", TypeConverters.toInt)
    n_threads = _param("n_threads", "read and kept: Spark's cores are used", TypeConverters.toInt)
    max_bin = _param("max_bin", "bins of a feature", TypeConverters.toInt)
    subsample = _param("subsample", "share of rows of each tree", TypeConverters.toFloat)
    device = _param("device", "read and kept: trees are grown on executors", TypeConverters.toString)
    objective = _param("objective", "mse, mae, huber, quantile or poisson", TypeConverters.toString)
    quantile_alpha = _param("quantile_alpha", "the quantile that is fitted", TypeConverters.toFloat)
    row_id = _param("row_id", "column that tells rows apart", TypeConverters.toString)
    params_json = _param("params_json", "dotted parameters as JSON, which win over the others", TypeConverters.toString)

    DEFAULTS = {"n_iters": 100, "learning_rate": 0.05, "max_depth": 6, "max_leaves": 31, "grower": "leafwise", "sampler": "all_rows", "early_stopping_rounds": 0, "random_seed": 42, "n_threads": 0}

    def get_params(self) -> dict[str, Any]:
        return {p.name: v for p, v in self.extractParamMap().items()}

    def set_params(self, **values: Any):
        unknown = [k for k in values if not self.hasParam(k)]
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        return self._set(**{k: v for k, v in values.items() if v is not None})

    def _value(self, name: str) -> Any:
        return self.getOrDefault(name) if self.isDefined(name) else None


class _Fit(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, n_iters: int = 100, learning_rate: float = 0.05, max_depth: int = 6, max_leaves: int = 31, grower: str = "leafwise", sampler: str = "all_rows", params: Params | Mapping[str, Any] | None = None, **more: Any):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        own = {"n_iters": n_iters, "learning_rate": learning_rate, "max_depth": max_depth, "max_leaves": max_leaves, "grower": grower, "sampler": sampler}
        if params is not None:
            own["params_json"] = json.dumps((Params.from_dict(params) if isinstance(params, Mapping) else params).to_dict())
        self.set_params(**own, **more)

    def _objective(self) -> dict[str, Any]:
        return {}

    def _all(self) -> Params:
        sampler = "bernoulli" if self._value("subsample") is not None and self._value("sampler") == "all_rows" else self._value("sampler")
        keys = {"booster.n_iters": "n_iters", "booster.learning_rate": "learning_rate", "booster.early_stopping_rounds": "early_stopping_rounds", "booster.random_seed": "random_seed", "tree.max_depth": "max_depth", "tree.max_leaves": "max_leaves", "dispatch.grower_name": "grower", "parallel.n_threads": "n_threads", "bin_mapper.max_bin": "max_bin", "sampler.subsample": "subsample"}
        base = {k: self._value(n) for k, n in keys.items() if self._value(n) is not None} | {"dispatch.sampler_name": sampler} | self._objective()
        return Params(base) | Params(json.loads(self._value("params_json") or "{}"))

    def fit(self, dataset: DataFrame, params=None, label: str | None = None, sample_weight: str | None = None, eval_set: DataFrame | None = None, init_model=None, row_id: str | None = None):
        """As any estimator's, with a parameter map or a list of them; or with the features' names and the label in its place."""
        if label is None:
            return super().fit(dataset, params)
        if isinstance(eval_set, (list, tuple)):
            raise ValueError("one evaluation table, not a list")
        own = self.copy()
        own._set(inputCols=list(params), labelCol=label)
        if sample_weight:
            own._set(weightCol=sample_weight)
        if row_id:
            own._set(row_id=row_id)
        return own._fit(dataset, eval_set, init_model)

    def _fit(self, dataset: DataFrame, eval_set: DataFrame | None = None, init_model=None):
        return self._trained(dataset, self._value("labelCol"), self._all(), eval_set, init_model)

    def _trained(self, df: DataFrame, label: str, params: Params, eval_set: DataFrame | None, init_model, **more: Any):
        features, start = self.getInputCols(), getattr(init_model, "engine", init_model)
        if start is not None and start.features != features:
            if set(start.features) == set(features):
                warnings.warn("features are in another order than the initial model's", stacklevel=4)
            raise ValueError("the initial model has other features")
        engine = train(params, df, features, label, self._value("weightCol"), self._value("row_id"), eval_set, start)
        return self._copyValues(self.FITTED(engine, **more))


class _Writer(MLWriter):
    def __init__(self, instance: _Model):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata={"own": self.instance._own()})
        self.instance.engine.save(f"{path}/engine")


class _Reader(MLReader):
    def __init__(self, cls: type[_Model]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _Model:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls(Model.load(f"{path}/engine"), **meta["own"])
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


class _Model(Fitted, _Settings, MLReadable, MLWritable):
    """A fitted stage around an ``engine`` model."""

    def __init__(self, engine: Model):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self.engine = engine

    def _own(self) -> dict[str, Any]:
        return {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.predict(dataset, self.getPredictionCol())

    def _checked(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.engine.features if c not in df.columns]
        if missing:
            raise ValueError(f"features seen at fit time are missing: {', '.join(missing)}")
        return df

    @property
    def n_iters_(self) -> int:
        return self.engine.n_iters

    @property
    def feature_names_in_(self) -> list[str]:
        return self.engine.features

    def evals_result(self) -> dict[str, dict[str, list[float]]]:
        """The evaluation set's losses of the rounds that were measured, by set and objective; empty without one."""
        losses = [x for x in self.engine.eval_history if not np.isnan(x)]
        return {"valid": {self.engine.objective.name: losses}} if losses else {}

    def _stopped(self, name: str) -> list[float]:
        if not self._value("early_stopping_rounds") or not self.evals_result():
            raise AttributeError(f"{name} needs early stopping and an evaluation set")
        return self.engine.eval_history

    @property
    def best_iteration(self) -> int:
        """The round of the least loss; rounds of an initial model count."""
        return int(np.nanargmin(self._stopped("best_iteration")))

    @property
    def best_score(self) -> float:
        return float(np.nanmin(self._stopped("best_score")))

    @property
    def feature_importances_(self) -> list[float]:
        gains = self.engine.importance("gain")
        total = sum(gains)
        return [g / total for g in gains] if total else gains

    def importance(self, kind: str = "gain") -> list[float]:
        return self.engine.importance(kind)

    def dump(self) -> str:
        return self.engine.dump()

    def predict_leaf(self, df: DataFrame, out: str = "leaf") -> DataFrame:
        return self.engine.predict_leaf(self._checked(df), out)

    def contributions(self, df: DataFrame, out: str = "contributions") -> DataFrame:
        return self.engine.contributions(self._checked(df), out)

    def staged_predict(self, df: DataFrame, row_id: str, out: str = "raw") -> DataFrame:
        return self.engine.predict_staged(self._checked(df), row_id, out)


class RegressorModel(_Model):
    def predict(self, df: DataFrame, out: str = "prediction", num_iteration: int | None = None) -> DataFrame:
        return self.engine.predict(self._checked(df), out, num_iteration)

    def score(self, df: DataFrame, label: str, sample_weight: str | None = None) -> float:
        """R squared, weighted."""
        p = fresh(df, "prediction")
        return float(self.predict(df, p).agg(M.r2(p, label, sample_weight, None)).first()[0])


class Regressor(_Fit):
    """Regression by squared, absolute, Huber, quantile or Poisson loss."""

    FITTED = RegressorModel

    @keyword_only
    def __init__(self, *, n_iters: int = 100, learning_rate: float = 0.05, max_depth: int = 6, max_leaves: int = 31, grower: str = "leafwise", sampler: str = "all_rows", objective: str = "mse", early_stopping_rounds: int = 0, n_threads: int = 0, random_seed: int = 42, max_bin: int | None = None, subsample: float | None = None, device: str | None = None, quantile_alpha: float | None = None, params=None, inputCols: list[str] | None = None, labelCol: str | None = None, predictionCol: str | None = None, weightCol: str | None = None, row_id: str | None = None):
        super().__init__(**({"objective": objective} | self._input_kwargs))

    def _objective(self) -> dict[str, Any]:
        return {"dispatch.objective_name": self._value("objective") or "mse"} | ({} if self._value("quantile_alpha") is None else {"objective.quantile_alpha": self._value("quantile_alpha")})

    @classmethod
    def from_file(cls, path: str) -> RegressorModel:
        """A stage around a model that ``Model.save`` wrote."""
        return RegressorModel(Model.load(path))


class ClassifierModel(_Model, HasProbabilityCol):
    def __init__(self, engine: Model, classes: list[Any]):
        super().__init__(engine)
        self.classes_ = list(classes)

    def _own(self) -> dict[str, Any]:
        return {"classes": self.classes_}

    @property
    def n_classes_(self) -> int:
        return len(self.classes_)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.predict(self.predict_proba(dataset, self.getProbabilityCol()), self.getPredictionCol())

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """An array of the classes' probabilities, in the order of ``classes_``."""
        got = self.engine.predict_proba(self._checked(df), out)
        return got if self.engine.n_classes > 1 else got.withColumn(out, F.array(1.0 - F.col(out), F.col(out)))

    def predict(self, df: DataFrame, out: str = "prediction", num_iteration: int | None = None) -> DataFrame:
        code = fresh(df, "code")
        got = self.engine.predict(self._checked(df), code, num_iteration)
        at = F.col(code) if self.engine.n_classes > 1 else (F.col(code) >= 0.5).cast("int")
        return got.withColumn(out, F.element_at(F.array(*[F.lit(c) for c in self.classes_]), at + 1)).drop(code)

    def score(self, df: DataFrame, label: str, sample_weight: str | None = None) -> float:
        """Accuracy, weighted."""
        p = fresh(df, "prediction")
        w = F.col(sample_weight).cast("double") if sample_weight else F.lit(1.0)
        hit = (F.col(p) == F.col(label)).cast("double")
        return float(self.predict(df, p).agg(F.sum(w * hit) / F.sum(w)).first()[0])


class Classifier(_Fit, HasProbabilityCol):
    """Two classes by logistic loss, more by softmax; labels of any type that sorts."""

    FITTED = ClassifierModel
    #: Classes whose names the driver holds at most.
    MOST_CLASSES = 10_000

    @keyword_only
    def __init__(self, *, n_iters: int = 100, learning_rate: float = 0.05, max_depth: int = 6, max_leaves: int = 31, grower: str = "leafwise", sampler: str = "all_rows", early_stopping_rounds: int = 0, n_threads: int = 0, random_seed: int = 42, max_bin: int | None = None, subsample: float | None = None, device: str | None = None, params=None, inputCols: list[str] | None = None, labelCol: str | None = None, predictionCol: str | None = None, probabilityCol: str | None = None, weightCol: str | None = None, row_id: str | None = None):
        super().__init__(**self._input_kwargs)

    def _fit(self, dataset: DataFrame, eval_set: DataFrame | None = None, init_model=None) -> ClassifierModel:
        label = self._value("labelCol")
        if dataset.where(F.col(label).isNull() | (F.isnan(label) if dict(dataset.dtypes)[label] in ("float", "double") else F.lit(False))).limit(1).count():
            raise ValueError("labels must not be missing")
        found = [r[0] for r in dataset.select(label).distinct().limit(self.MOST_CLASSES + 1).collect()]
        if not 2 <= len(found) <= self.MOST_CLASSES:
            raise ValueError(f"2 to {self.MOST_CLASSES} classes, not {len(found)}")
        classes = sorted(found)
        code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
        if eval_set is not None and eval_set.where(F.col(label).isNull() | ~F.col(label).isin(classes)).limit(1).count():
            raise ValueError("the evaluation set has a label that training lacks")
        more = {"dispatch.objective_name": "logloss"} if len(found) == 2 else {"dispatch.objective_name": "softmax", "objective.n_classes": len(found)}
        own = fresh(dataset, "code")
        coded = None if eval_set is None else eval_set.withColumn(own, code)
        return self._trained(dataset.withColumn(own, code), own, self._all() | more, coded, init_model, classes=classes)

    @classmethod
    def from_file(cls, path: str) -> ClassifierModel:
        """A stage around a model that ``Model.save`` wrote; its classes are numbered."""
        engine = Model.load(path)
        return ClassifierModel(engine, list(range(max(2, engine.n_classes))))
