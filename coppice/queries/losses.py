"""Objectives, links, initial scores, losses and metrics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import objectives as J
from ..functions.ranking import nearest_rank
from ..plans.model import best_class
from .base import EVENTS, LINES, SIGMOID, Catalog, events, lines

query = Catalog()
S = "(q - 25.0e0) / 10.0e0"  # a score for the returnflag


def _one(spark, name: str, value) -> object:
    return spark.createDataFrame([(round(float(value), 4),)], f"{name} double")


SRC = f"WITH {LINES} SELECT "
query(SRC + "round(avg(y), 4) AS init FROM lines", "init_mse")(lambda s, d: _one(s, "init", J.Objective("mse").init_score(lines(s, d), "y")))
query(SRC + "round(ln(avg(r) / (1 - avg(r))), 4) AS init FROM lines", "init_logloss")(lambda s, d: _one(s, "init", J.Objective("logloss").init_score(lines(s, d), "r")))
query("SELECT round(ln(avg(l_linenumber)), 4) AS init FROM lineitem", "init_poisson")(lambda s, d: _one(s, "init", J.Objective("poisson").init_score(s.read.parquet(f"{d}/lineitem.parquet"), "l_linenumber")))
query("SELECT round(y, 4) AS init FROM (SELECT l_extendedprice AS y, row_number() OVER (ORDER BY l_extendedprice) - 1 AS rn, count(*) OVER () AS n FROM lineitem) WHERE rn = least(n - 1, floor(0.5 * (n - 1) + 0.5))", "init_median")(lambda s, d: _one(s, "init", J.Objective("mae").init_score(lines(s, d), "y")))
query("SELECT round(y, 4) AS init FROM (SELECT l_extendedprice AS y, row_number() OVER (ORDER BY l_extendedprice) - 1 AS rn, count(*) OVER () AS n FROM lineitem) WHERE rn = least(n - 1, floor(0.9 * (n - 1) + 0.5))", "init_quantile")(lambda s, d: _one(s, "init", J.Objective("quantile", alpha=0.9).init_score(lines(s, d), "y")))


@query(f"WITH {EVENTS} SELECT kind, round(ln(greatest(count(*), 1) / (SELECT count(*) FROM ev)::DOUBLE), 6) AS init FROM ev GROUP BY kind")
def init_softmax(spark, d):
    got = J.softmax_init(events(spark, d), 5, "kind")
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(got)], "kind int, init double")


# Gradients and losses at the score 2000 * q for prices, ``S`` for flags.
def _price():
    return F.col("q").cast("double") * 2000.0


def _score():
    return (F.col("q") - 25.0) / 10.0


CLIPPED = "greatest(-30.0e0, least(30.0e0, {}))"
COUNT = "SELECT l_linenumber::DOUBLE AS n, (l_quantity - 25.0) / 10.0 AS s FROM lineitem"
GRADS = {
    "mse": (J.Objective("mse"), "2000.0e0 * q - y", "1.0e0", "(2000.0e0 * q - y) * (2000.0e0 * q - y)"),
    "mae": (J.Objective("mae"), "sign(2000.0e0 * q - y)::DOUBLE", "1.0e0", "abs(2000.0e0 * q - y)"),
    "huber": (J.Objective("huber", delta=5000.0), "greatest(-5000.0e0, least(5000.0e0, 2000.0e0 * q - y))", "1.0e0", "CASE WHEN abs(2000.0e0 * q - y) <= 5000 THEN 0.5e0 * pow(2000.0e0 * q - y, 2) ELSE 5000.0e0 * (abs(2000.0e0 * q - y) - 2500.0e0) END"),
    "quantile": (J.Objective("quantile", alpha=0.7), "CASE WHEN 2000.0e0 * q > y THEN 0.3e0 ELSE -0.7e0 END", "1.0e0", "CASE WHEN y >= 2000.0e0 * q THEN 0.7e0 * (y - 2000.0e0 * q) ELSE 0.3e0 * (2000.0e0 * q - y) END"),
}


def _by_rows(df, objective, weighted=False):
    """g, h and loss of rows (p, y, w), as training makes them of a block."""

    def run(batches):
        for b in batches:
            p, y, w = (b.column(c).to_numpy().astype(float) for c in ("p", "y", "w"))
            g, h = objective.grad_hess(p, y)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((g * w, h * w) if weighted else (g, h))] + [pa.array(objective.loss(p, y))], ["g", "h", "loss"])

    return df.mapInArrow(run, "g double, h double, loss double")


def _prices(s, d):
    return lines(s, d).select(_price().alias("p"), "y", "w")


def _flags(s, d):
    return lines(s, d).select(_score().alias("p"), F.col("r").alias("y"), "w")


def _counts(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").select(((F.col("l_quantity") - 25.0) / 10.0).alias("p"), F.col("l_linenumber").cast("double").alias("y"), F.lit(1.0).alias("w"))


def _grad(df, digits):
    return df.select(F.round("g", digits).alias("g"), F.round("h", digits).alias("h"))


for _name, (_o, _g, _h, _l) in GRADS.items():
    query(SRC + f"round({_g}, 3) AS g, {_h} AS h FROM lines", f"grad_{_name}")(lambda s, d, o=_o: _grad(_by_rows(_prices(s, d), o), 3))
    query(SRC + f"round(avg({_l}), 2) AS loss FROM lines", f"loss_{_name}")(lambda s, d, o=_o: _by_rows(_prices(s, d), o).agg(F.round(F.avg("loss"), 2).alias("loss")))
LOGIT, POIS = J.Objective("logloss"), J.Objective("poisson")
query(SRC + f"round({SIGMOID.format(S)} - r, 6) AS g, round({SIGMOID.format(S)} * (1 - {SIGMOID.format(S)}), 6) AS h FROM lines", "grad_logloss")(lambda s, d: _grad(_by_rows(_flags(s, d), LOGIT), 6))
query(SRC + f"round(avg(greatest(0, {S}) + ln(1 + exp(-abs({S}))) - r * {S}), 6) AS loss FROM lines", "loss_logloss")(lambda s, d: _by_rows(_flags(s, d), LOGIT).agg(F.round(F.avg("loss"), 6).alias("loss")))
query(f"SELECT round(exp({CLIPPED.format('s')}) - n, 6) AS g, round(exp({CLIPPED.format('s')}), 6) AS h FROM ({COUNT})", "grad_poisson")(lambda s, d: _grad(_by_rows(_counts(s, d), POIS), 6))
query(f"SELECT round(avg(exp({CLIPPED.format('s')}) - n * {CLIPPED.format('s')}), 5) AS loss FROM ({COUNT})", "loss_poisson")(lambda s, d: _by_rows(_counts(s, d), POIS).agg(F.round(F.avg("loss"), 5).alias("loss")))
query(SRC + f"round({SIGMOID.format(S)}, 6) AS p FROM lines", "link_sigmoid")(lambda s, d: lines(s, d).select(F.round(LOGIT.link(_score()), 6).alias("p")))
query(SRC + f"round(exp({S}), 6) AS p FROM lines", "link_exp")(lambda s, d: lines(s, d).select(F.round(POIS.link(_score()), 6).alias("p")))
query(SRC + "round((2000.0e0 * q - y) * w, 3) AS g, round(w, 3) AS h FROM lines", "weighted_grad")(lambda s, d: _grad(_by_rows(_prices(s, d), GRADS["mse"][0], True), 3))

# Five scores of each event: its k, hour and value on different scales.
SOFT = f"WITH {EVENTS}, s AS (SELECT *, [k / 50.0e0, h / 12.0e0, ln(1 + value), 1.0e0, (k - h) / 40.0e0] AS z FROM ev), e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS x FROM s), p AS (SELECT *, list_transform(x, lambda y: y / list_sum(x)) AS p FROM e)"


def _scores(s, d):
    k, h = F.col("k").cast("double"), F.col("h").cast("double")
    return events(s, d).withColumn("z", F.array(k / 50.0, h / 12.0, F.ln(1 + F.col("value")), F.lit(1.0), (F.col("k") - F.col("h")).cast("double") / 40.0))


@query(SOFT + " SELECT event_id, kind AS label, i - 1 AS k, round(p[i] - CASE WHEN kind = i - 1 THEN 1 ELSE 0 END, 6) AS g, round(greatest(p[i] * (1 - p[i]), 1e-6), 6) AS h FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS i)")
def softmax_grad(spark, d):
    e = _softmax(spark, d).select("event_id", "label", F.posexplode(F.arrays_zip("g", "h")).alias("k", "x"))
    return e.select("event_id", "label", "k", F.round("x.g", 6).alias("g"), F.round("x.h", 6).alias("h"))


def _softmax(spark, d):
    """event_id, label, g, h (by class) and loss."""
    objective = J.Objective("softmax", n_classes=5)

    def run(batches):
        for b in batches:
            p = b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 5)
            y = b.column("kind").to_numpy()
            g, h = objective.grad_hess(p, y)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), b.column("kind"), *[pa.array(list(x), pa.list_(pa.float64())) for x in (g, h)], pa.array(objective.loss(p, y))], ["event_id", "label", "g", "h", "loss"])

    return _scores(spark, d).select("event_id", "kind", "z").mapInArrow(run, "event_id long, label int, g array<double>, h array<double>, loss double")


@query(SOFT + " SELECT round(avg(-ln(p[kind + 1])), 6) AS loss FROM p")
def loss_softmax(spark, d):
    return _softmax(spark, d).agg(F.round(F.avg("loss"), 6).alias("loss"))


@query(SOFT + " SELECT event_id, round(p[1], 6) AS p0, round(p[3], 6) AS p2 FROM p")
def softmax_proba(spark, d):
    p = _scores(spark, d).withColumn("p", J.softmax(F.col("z")))
    return p.select("event_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[2], 6).alias("p2"))


@query(SOFT + " SELECT event_id, list_position(z, list_max(z)) - 1 AS prediction FROM p")
def predict_argmax(spark, d):
    return _scores(spark, d).select("event_id", best_class(F.col("z")).alias("prediction"))


def _m(s, d, agg, digits=6):
    return lines(s, d).withColumns({"p": _price(), "s": _score()}).agg(F.round(agg, digits).alias("value"))


query(SRC + "round(sqrt(avg(pow(2000.0e0 * q - y, 2))), 4) AS value FROM lines", "metric_rmse")(lambda s, d: _m(s, d, M.rmse("p", "y"), 4))
query(SRC + "round(avg(abs(2000.0e0 * q - y)), 4) AS value FROM lines", "metric_mae")(lambda s, d: _m(s, d, M.mae("p", "y"), 4))
query(SRC + "round(1 - sum(pow(2000.0e0 * q - y, 2)) / (var_pop(y) * count(*)), 6) AS value FROM lines", "metric_r2")(lambda s, d: _m(s, d, M.r2("p", "y")))
query(SRC + f"round(avg(greatest(0, {S}) + ln(1 + exp(-abs({S}))) - r * {S}), 6) AS value FROM lines", "metric_logloss")(lambda s, d: _m(s, d, M.logloss("s", "r")))
query(SRC + f"round(avg(CASE WHEN ({S} >= 0.5) = (r >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS value FROM lines", "metric_accuracy")(lambda s, d: _m(s, d, M.accuracy("s", "r")))
query(SRC + "round(1 - sum(w * pow(2000.0e0 * q - y, 2)) / (sum(w * y * y) - pow(sum(w * y), 2) / sum(w)), 6) AS value FROM lines", "score_r2_w")(lambda s, d: _m(s, d, M.r2("p", "y", "w", None)))
query(SRC + f"round(sum(w * CASE WHEN ({S} >= 0.5) = (r >= 0.5) THEN 1.0 ELSE 0.0 END) / sum(w), 6) AS value FROM lines", "score_acc_w")(lambda s, d: _m(s, d, M.accuracy("s", "r", "w")))


@query(f"""WITH {EVENTS}, x AS (SELECT value AS s, buy, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0e0 AS rk FROM ev)
SELECT round((sum(rk) FILTER (WHERE buy = 1) - sum(buy) * (sum(buy) + 1) / 2) / (sum(buy) * (count(*) - sum(buy))), 6) AS value FROM x""")
def metric_auc(spark, d):
    return M.auc(events(spark, d), "value", "buy").select(F.round("value", 6).alias("value"))


@query(f"""WITH {EVENTS}, x AS (SELECT value AS s, kind - 1 AS y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0e0 AS rk FROM ev), n AS (SELECT count(*) FILTER (WHERE y > 0) AS p, count(*) AS n FROM x)
SELECT 'auc' AS metric, round((sum(rk) FILTER (WHERE y > 0) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * (any_value(n) - any_value(p))), 6) AS value FROM x, n UNION ALL SELECT 'auc, one class', 'NaN'::DOUBLE UNION ALL SELECT 'r2, constant', 'NaN'::DOUBLE""")
def metric_bench(spark, d):
    e = events(spark, d).withColumn("y", F.col("kind") - 1)
    rows = [("auc", M.bench_auc(e, "value", "y").first()[0]), ("auc, one class", M.bench_auc(e.where("y > 0"), "value", "y").first()[0]), ("r2, constant", e.where("y = 1").agg(M.bench_r2("value", "y")).first()[0])]
    return spark.createDataFrame([(k, round(x, 6)) for k, x in rows], "metric string, value double")


@query(f"WITH {EVENTS} SELECT round(avg(CASE WHEN (k::INT % 5) = kind THEN 1.0 ELSE 0.0 END), 6) AS value FROM ev")
def metric_mc_accuracy(spark, d):
    e = events(spark, d).withColumn("p", (F.col("k").cast("int") % 5).cast("double"))
    return e.agg(F.round(M.mc_accuracy("p", "kind"), 6).alias("value"))


@query("SELECT l_returnflag AS leaf, round(y, 4) AS q FROM (SELECT l_returnflag, l_extendedprice AS y, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE rn = least(n - 1, floor(0.9 * (n - 1) + 0.5))")
def group_quantile(spark, d):
    src = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("leaf"), "l_extendedprice")
    return nearest_rank(src, "l_extendedprice", 0.9, ["leaf"]).withColumn("q", F.round("q", 4))


QUERIES, ORACLE = query.queries, query.sql
