"""Ordered target encoding of categories, as windows and joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import order_key

PAIR = 1 << 32


def category(c: Column) -> Column:
    """Missing values are a category of their own."""
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(-1.0)).otherwise(c.cast("double")) + F.lit(0.0)


def pair_key(a: Column, b: Column) -> Column:
    return category(a) * F.lit(float(PAIR)) + category(b)


def full_stats(df: DataFrame, cat: str, y: str, prior_weight: float = 10.0, prior: float | None = None) -> DataFrame:
    """(cat, value): (sum y + a * prior) / (n + a)."""
    prior = df.agg(F.avg(F.col(y).cast("double"))).first()[0] if prior is None else prior
    g = df.groupBy(cat).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count("*").alias("n"))
    return g.select(cat, ((F.col("s") + prior_weight * prior) / (F.col("n") + prior_weight)).alias("value"))


def ordered(df: DataFrame, cat: str, y: str, row_id: str, prior_weight: float = 10.0, seed: int = 0, prior: float | None = None, name: str = "te", salt: int = 64) -> DataFrame:
    """Adds each row's encoding from the rows of its category before it in the seeded order.

    A category's order is cut into ``salt`` ranges of the order key; a range's running sums
    start from the totals of those before it, so a category that holds a third of
    all rows is spread over ``salt`` windows.
    """
    prior = df.agg(F.avg(F.col(y).cast("double"))).first()[0] if prior is None else prior
    keyed = df.withColumn("_key", order_key(row_id, seed)).withColumn("_range", F.floor(F.col("_key") * salt / F.lit(float(PAIR))).cast("int"))
    ends = keyed.groupBy(F.col(cat).alias("_cat"), F.col("_range").alias("_r")).agg(F.sum(F.col(y).cast("double")).alias("_s"), F.count("*").alias("_n"))
    ahead = Window.partitionBy("_cat").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("_cat", "_r", F.coalesce(F.sum("_s").over(ahead), F.lit(0.0)).alias("_bs"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_bn"))
    w = Window.partitionBy(cat, "_range").orderBy("_key", row_id).rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumns({"_rs": F.coalesce(F.sum(F.col(y).cast("double")).over(w), F.lit(0.0)), "_rn": F.count("*").over(w)})
    out = run.join(base, F.col(cat).eqNullSafe(F.col("_cat")) & (F.col("_range") == F.col("_r")))
    te = (F.col("_rs") + F.col("_bs") + prior_weight * prior) / (F.col("_rn") + F.col("_bn") + prior_weight)
    return out.withColumn(name, te).drop("_key", "_range", "_cat", "_r", "_bs", "_bn", "_rs", "_rn")


class _Layout(HasInputCols, HasLabelCol):
    prior_weight = Param(Params._dummy(), "prior_weight", "rows that the prior counts for", typeConverter=TypeConverters.toFloat)
    n_permutations = Param(Params._dummy(), "n_permutations", "orders that encodings are averaged over", typeConverter=TypeConverters.toInt)
    keep_codes = Param(Params._dummy(), "keep_codes", "whether the columns stay", typeConverter=TypeConverters.toBoolean)
    seed = Param(Params._dummy(), "seed", "of the first order", typeConverter=TypeConverters.toInt)
    cross = Param(Params._dummy(), "cross", "2 encodes pairs of columns too", typeConverter=TypeConverters.toInt)

    def _keyed(self, df: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
        """``df`` with a key column for each encoding, and (encoding, key) names."""
        columns = self.getInputCols()
        keys = [(f"{c}_te", category(F.col(c))) for c in columns]
        if self.getOrDefault("cross") == 2:
            keys += [(f"{a}_{b}_te", pair_key(F.col(a), F.col(b))) for a, b in combinations(columns, 2)]
        return df.withColumns({f"_k_{n}": k for n, k in keys}), [(n, f"_k_{n}") for n, _ in keys]

    def _laid_out(self, df: DataFrame, names: list[str], before: list[str]) -> DataFrame:
        columns = self.getInputCols()
        singles, pairs = names[: len(columns)], names[len(columns) :]
        rest = [c for c in before if c not in columns]
        return df.select(*rest, *singles, *(columns if self.getOrDefault("keep_codes") else []), *pairs)


class OrderedTargetEncoderModel(Model, _Layout, DefaultParamsReadable, DefaultParamsWritable):
    """Encodes by full statistics; unseen categories get the prior."""

    prior = Param(Params._dummy(), "prior", "the mean target", typeConverter=TypeConverters.toFloat)

    def __init__(self, stats: DataFrame | None = None):
        super().__init__()
        self.stats = stats  # (name, key, value)

    def _transform(self, df: DataFrame) -> DataFrame:
        before, prior = df.columns, self.getOrDefault("prior")
        out, keys = self._keyed(df)
        for name, key in keys:
            own = self.stats.where(F.col("name") == name).select(F.col("key").alias(key), F.col("value").alias(name))
            out = out.join(own, key, "left").withColumn(name, F.coalesce(name, F.lit(prior)))
        return self._laid_out(out, [n for n, _ in keys], before)

    def save(self, path: str) -> None:
        super().save(f"{path}/stage")
        self.stats.write.parquet(f"{path}/stats")

    @classmethod
    def load(cls, path: str) -> OrderedTargetEncoderModel:
        out = super().load(f"{path}/stage")
        out.stats = SparkSession.getActiveSession().read.parquet(f"{path}/stats")
        return out


class OrderedTargetEncoder(Estimator, _Layout, DefaultParamsReadable, DefaultParamsWritable):
    """``fit_transform`` encodes causally; ``fit`` makes a stage that encodes by full statistics.

    The output has, in this order, ``<column>_te`` for each column, the codes (if kept),
    and ``<a>_<b>_te`` for each pair (cross = 2).
    """

    def __init__(self, columns: Sequence[str] = (), prior_weight: float = 10.0, n_permutations: int = 1, keep_codes: bool = True, seed: int = 0, cross: int = 1, labelCol: str | None = None):
        super().__init__()
        if cross not in (1, 2):
            raise ValueError("cross is 1 or 2")
        if n_permutations < 1 or prior_weight < 0:
            raise ValueError("needs a permutation at least and no negative prior weight")
        self._set(inputCols=list(columns), prior_weight=prior_weight, n_permutations=n_permutations, keep_codes=keep_codes, seed=seed, cross=cross, **({"labelCol": labelCol} if labelCol else {}))
        self.model_: OrderedTargetEncoderModel | None = None

    def _fit(self, dataset: DataFrame) -> OrderedTargetEncoderModel:
        y, weight = self.getLabelCol(), self.getOrDefault("prior_weight")
        if not self.getInputCols():
            raise ValueError("needs columns")
        prior = dataset.agg(F.avg(F.col(y).cast("double"))).first()[0]
        keyed, keys = self._keyed(dataset)
        parts = [full_stats(keyed, key, y, weight, prior).select(F.lit(name).alias("name"), F.col(key).alias("key"), "value") for name, key in keys]
        out = OrderedTargetEncoderModel(reduce(DataFrame.unionByName, parts))
        return self._copyValues(out)._set(prior=prior)

    def fit_transform(self, df: DataFrame, y: str, row_id: str) -> DataFrame:
        before = df.columns
        self._set(labelCol=y)
        self.model_ = self.fit(df)
        n, seed, weight = (self.getOrDefault(k) for k in ("n_permutations", "seed", "prior_weight"))
        out, keys = self._keyed(df)
        for name, key in keys:
            for p in range(n):
                out = ordered(out, key, y, row_id, weight, seed + p, self.prior, f"_p{p}")
            out = out.withColumn(name, sum(F.col(f"_p{p}") for p in range(n)) / n).drop(*[f"_p{p}" for p in range(n)])
        return self._laid_out(out, [name for name, _ in keys], before)

    def transform(self, df: DataFrame) -> DataFrame:
        """By the statistics of the last ``fit_transform``."""
        if self.model_ is None:
            raise ValueError("fit the encoder first")
        return self.model_.transform(df)

    @property
    def prior(self) -> float | None:
        return None if self.model_ is None else self.model_.getOrDefault("prior")
