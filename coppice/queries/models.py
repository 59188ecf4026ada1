"""Boosting, prediction and explanation, over events: features v (with missing values), h, k."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import Config
from ..functions import objectives as J
from ..functions.ranking import shared_dir
from ..operators import binning as B
from ..operators.binning import Cuts, close
from ..plans import booster, shap
from ..plans.model import Model
from ..plans.trees import Tree
from .base import EVENTS, SIGMOID, Catalog, events

query = Catalog()
NAMES = ("v", "h", "k")


def two_trees() -> list[Tree]:
    """v <= 50 (missing: left) ? (h <= 11 ? 1.5 : -0.5) : (k <= 50 ? 2 : -1), and h <= 5 ? 0.25 : (v <= 80 (missing: right) ? -0.75 : 0.5)."""
    a, b = Tree(), Tree()
    a.add(100)
    left, right = a.split(0, 0, 1, 50.0, True, 10.0, (60, 40))
    for n, (fid, at, x), values, covers, gain in ((left, (1, 1, 11.0), (1.5, -0.5), (40, 20), 4.0), (right, (2, 0, 50.0), (2.0, -1.0), (10, 30), 3.0)):
        for kid, v in zip(a.split(n, fid, at, x, True, gain, covers), values):
            a.value[kid] = v
    b.add(100)
    left, right = b.split(0, 1, 0, 5.0, False, 6.0, (25, 75))
    b.value[left] = 0.25
    for kid, v in zip(b.split(right, 0, 2, 80.0, False, 2.0, (50, 25)), (-0.75, 0.5)):
        b.value[kid] = v
    return [a, b]


def fixed(objective: str = "mse") -> Model:
    c = Config()
    c.dispatch.objective_name, c.booster.learning_rate = objective, 0.5
    cuts = Cuts(NAMES, (close([25.0, 50.0, 80.0]), close([5.0, 11.0]), close([50.0])))
    return Model(c, cuts, [0.125], two_trees())


T0 = "CASE WHEN v IS NULL OR v <= 50 THEN CASE WHEN h <= 11 THEN 1.5e0 ELSE -0.5e0 END ELSE CASE WHEN k <= 50 THEN 2.0e0 ELSE -1.0e0 END END"
T1 = "CASE WHEN h <= 5 THEN 0.25e0 WHEN v <= 80 THEN -0.75e0 ELSE 0.5e0 END"
RAW = f"0.125e0 + 0.5e0 * ({T0} + {T1})"
EV = f"WITH {EVENTS} SELECT event_id, "


def _r(df, *cols):
    return df.select("event_id", *[F.round(c, 6).alias(c) for c in cols])


query(EV + f"round({RAW}, 6) AS raw FROM ev", "predict_dense")(lambda s, d: _r(fixed().raw(events(s, d)), "raw"))
query(EV + f"round(0.125e0 + 0.5e0 * ({T0}), 6) AS raw FROM ev", "predict_prefix")(lambda s, d: _r(fixed().raw(events(s, d), num_iteration=1), "raw"))
query(EV + f"round({SIGMOID.format(RAW)}, 6) AS probability FROM ev", "predict_proba")(lambda s, d: _r(fixed("logloss").predict_proba(events(s, d)), "probability"))


@query(EV + f"round({RAW}, 6) AS raw FROM ev")
def predict_walk(spark, d):
    """The walk over Arrow batches that large ensembles take: here the two trees 250 times, at 1/250 of the rate."""
    m = fixed()
    m.trees = m.trees * 250
    m.config.booster.learning_rate = 0.5 / 250
    return _r(m.raw(events(spark, d)), "raw")


@query(EV + "round(0.125e0 + 0.5e0 * CASE WHEN coalesce(v <= 50, true) THEN CASE WHEN h <= 11 THEN 1.0e0 ELSE -2.0e0 END ELSE CASE WHEN h <= 11 THEN 3.0e0 ELSE 0.5e0 END END, 6) AS raw FROM ev")
def predict_oblivious(spark, d):
    t = Tree()
    t.add(100)
    kids = t.split(0, 0, 1, 50.0, True, 10.0, (60, 40))
    t.levels = [0, kids[0]]
    for n, values in zip(kids, ((1.0, -2.0), (3.0, 0.5))):
        for kid, v in zip(t.split(n, 1, 1, 11.0, True, 4.0, (30, 10)), values):
            t.value[kid] = v
    m = fixed()
    m.trees = [t]
    return _r(m.raw(events(spark, d)), "raw")


@query(f"WITH {EVENTS} SELECT event_id, 1 AS iteration, round(0.125e0 + 0.5e0 * ({T0}), 6) AS raw FROM ev UNION ALL SELECT event_id, 2, round({RAW}, 6) FROM ev")
def predict_staged(spark, d):
    return fixed().predict_staged(events(spark, d), "event_id").withColumn("raw", F.round("raw", 6))


@query(EV + "CASE WHEN v IS NULL OR v <= 50 THEN CASE WHEN h <= 11 THEN 3 ELSE 4 END ELSE CASE WHEN k <= 50 THEN 5 ELSE 6 END END AS leaf0, CASE WHEN h <= 5 THEN 1 WHEN v <= 80 THEN 3 ELSE 4 END AS leaf1 FROM ev")
def predict_leaf(spark, d):
    got = fixed().predict_leaf(events(spark, d))
    return got.select("event_id", F.col("leaf")[0].alias("leaf0"), F.col("leaf")[1].alias("leaf1"))


def binned(m: Model, spark, d):
    return B.bin_arrays(events(spark, d), m.cuts, ["event_id"])


@query(EV + f"round({RAW}, 6) AS raw, round({SIGMOID.format(RAW)}, 6) AS probability, CASE WHEN v IS NULL OR v <= 50 THEN CASE WHEN h <= 11 THEN 3 ELSE 4 END ELSE CASE WHEN k <= 50 THEN 5 ELSE 6 END END AS leaf0 FROM ev")
def predict_binned(spark, d):
    """Raw scores, probabilities and leaves of a table of bins."""
    m = fixed("logloss")
    got = m.predict_leaf(m.predict_proba(m.raw(binned(m, spark, d), binned=True), binned=True), binned=True)
    return got.select("event_id", F.round("raw", 6).alias("raw"), F.round("probability", 6).alias("probability"), F.col("leaf")[0].alias("leaf0"))


# Explanation: the expectation of a tree for each subset of known features, by cover, written out.
def known(tree: int, s: set[str]) -> str:
    v = "CASE WHEN coalesce(v <= 50, true) THEN {a} ELSE {b} END" if "v" in s else "(0.6e0 * {a} + 0.4e0 * {b})"
    h = "CASE WHEN h <= 11 THEN 1.5e0 ELSE -0.5e0 END" if "h" in s else f"({40 / 60!r} * 1.5e0 + {20 / 60!r} * -0.5e0)"
    k = "CASE WHEN k <= 50 THEN 2.0e0 ELSE -1.0e0 END" if "k" in s else "(0.25e0 * 2.0e0 + 0.75e0 * -1.0e0)"
    if tree == 0:
        return v.format(a=f"({h})", b=f"({k})")
    v1 = "CASE WHEN coalesce(v <= 80, false) THEN -0.75e0 ELSE 0.5e0 END" if "v" in s else f"({50 / 75!r} * -0.75e0 + {25 / 75!r} * 0.5e0)"
    return f"CASE WHEN h <= 5 THEN 0.25e0 ELSE {v1} END" if "h" in s else f"(0.25e0 * 0.25e0 + 0.75e0 * ({v1}))"


def shapley(f: str) -> str:
    others = [x for x in NAMES if x != f]
    terms = []
    for s, w in ((set(), 1 / 3), ({others[0]}, 1 / 6), ({others[1]}, 1 / 6), (set(others), 1 / 3)):
        terms += [f"{w!r} * (({known(t, s | {f})}) - ({known(t, s)}))" for t in (0, 1)]
    return "0.5e0 * (" + " + ".join(terms) + ")"


BIAS = f"0.125e0 + 0.5e0 * ({known(0, set())} + {known(1, set())})"


@query(EV + ", ".join(f"round({shapley(f)}, 6) AS phi_{f}" for f in NAMES) + f", round({BIAS}, 6) AS bias FROM ev")
def shap_values(spark, d):
    got = fixed().contributions(events(spark, d))
    return got.select("event_id", *[F.round(F.col("contributions")[i], 6).alias(n) for i, n in enumerate(("phi_v", "phi_h", "phi_k", "bias"))])


@query(EV + ", ".join(f"round({shapley(f)}, 6) AS phi_{f}" for f in NAMES) + f", round({BIAS}, 6) AS bias FROM ev")
def shap_binned(spark, d):
    m = fixed()
    got = m.contributions(binned(m, spark, d), binned=True)
    return got.select("event_id", *[F.round(F.col("contributions")[i], 6).alias(n) for i, n in enumerate(("phi_v", "phi_h", "phi_k", "bias"))])


@query(f"WITH {EVENTS} SELECT event_id, 1 AS iteration, round(0.125e0 + 0.5e0 * ({T0}), 6) AS raw FROM ev UNION ALL SELECT event_id, 2, round({RAW}, 6) FROM ev")
def staged_binned(spark, d):
    m = fixed()
    return m.predict_staged(binned(m, spark, d), "event_id", binned=True).withColumn("raw", F.round("raw", 6))


@query(EV + "true AS additive FROM ev")
def shap_additivity(spark, d):
    m = fixed()
    got = m.raw(m.contributions(events(spark, d)))
    gap = F.abs(F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) - F.col("raw")) / F.greatest(F.lit(1.0), F.abs("raw"))
    return got.select("event_id", (gap < 1e-9).alias("additive"))


@query(f"SELECT 0 AS tree, round({known(0, set())}, 6) AS expected UNION ALL SELECT 1, round({known(1, set())}, 6)")
def shap_expected(spark, d):
    return spark.createDataFrame([(i, round(t.expected(), 6)) for i, t in enumerate(two_trees())], "tree int, expected double")


INF = "'infinity'::DOUBLE"


@query(f"""SELECT path::INT AS path, fid::INT AS fid, lo::DOUBLE AS lo, hi::DOUBLE AS hi, missing, round(zero, 6) AS zero, value::DOUBLE AS value FROM (VALUES
    (0, 0, -{INF}, 50.0, true, 0.6e0, 1.5), (0, 1, -{INF}, 11.0, true, 40 / 60e0, 1.5), (1, 0, -{INF}, 50.0, true, 0.6e0, -0.5), (1, 1, 11.0, {INF}, false, 20 / 60e0, -0.5),
    (2, 0, 50.0, {INF}, false, 0.4e0, 2.0), (2, 2, -{INF}, 50.0, true, 0.25e0, 2.0), (3, 0, 50.0, {INF}, false, 0.4e0, -1.0), (3, 2, 50.0, {INF}, false, 0.75e0, -1.0),
    (4, 1, -{INF}, 5.0, false, 0.25e0, 0.25), (5, 0, -{INF}, 80.0, false, 50 / 75e0, -0.75), (5, 1, 5.0, {INF}, true, 0.75e0, -0.75), (6, 0, 80.0, {INF}, true, 25 / 75e0, 0.5), (6, 1, 5.0, {INF}, true, 0.75e0, 0.5))
    t(path, fid, lo, hi, missing, zero, value)""")
def shap_paths(spark, d):
    rows = list(shap.path_rows(shap.pack(two_trees())))
    return spark.createDataFrame(rows, "path int, fid int, lo double, hi double, missing boolean, zero double, value double").withColumn("zero", F.round("zero", 6))


query("SELECT unnest([0, 1, 2]) AS fid, unnest([2.0e0, 2.0e0, 1.0e0]) AS importance", "importance_split")(lambda s, d: s.createDataFrame(list(enumerate(fixed().importance("split"))), "fid int, importance double"))
query("SELECT unnest([0, 1, 2]) AS fid, unnest([12.0e0, 10.0e0, 3.0e0]) AS importance", "importance_gain")(lambda s, d: s.createDataFrame(list(enumerate(fixed().importance("gain"))), "fid int, importance double"))


# Renewal: leaves of the first tree, residuals of value against a constant score.
LEAF = "CASE WHEN v IS NULL OR v <= 50 THEN CASE WHEN h <= 11 THEN 3 ELSE 4 END ELSE CASE WHEN k <= 50 THEN 5 ELSE 6 END END"


def ranked(alpha: float) -> str:
    return f"{EVENTS}, x AS (SELECT {LEAF} AS leaf, value - 30.0e0 AS r FROM ev), y AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY r) - 1 AS rn, count(*) OVER (PARTITION BY leaf) AS n FROM x), m AS (SELECT leaf, r AS med FROM y WHERE rn = least(n - 1, floor({alpha} * (n - 1) + 0.5)))"


def _renew(spark, d, objective):
    got = fixed().predict_leaf(events(spark, d)).select(F.col("leaf")[0].alias("leaf"), (F.col("value") - 30.0).alias("r"))
    values = booster.renewed(got, lambda b: (b.column("leaf").to_numpy(), b.column("r").to_numpy()), objective, [3, 4, 5, 6])
    return spark.createDataFrame([(k, round(v, 4)) for k, v in values.items()], "leaf int, value double")


query(f"WITH {ranked(0.5)} SELECT leaf, round(med, 4) AS value FROM m", "renew_mae")(lambda s, d: _renew(s, d, J.Objective("mae")))
query(f"WITH {ranked(0.8)} SELECT leaf, round(med, 4) AS value FROM m", "renew_quantile")(lambda s, d: _renew(s, d, J.Objective("quantile", alpha=0.8)))
query(f"WITH {ranked(0.5)} SELECT leaf, round(any_value(med) + avg(greatest(-20.0, least(20.0, r - med))), 4) AS value FROM x JOIN m USING (leaf) GROUP BY leaf", "renew_huber")(lambda s, d: _renew(s, d, J.Objective("huber", delta=20.0)))


# Two rounds of stumps, unrolled.
def stumps(label: str, start: str, grad: str, hess: str, out: str) -> str:
    """SQL of two depth-1 rounds on h alone: 24 hours, exact cuts, no missing values."""

    def best(n: int) -> str:
        return f"""c{n} AS (SELECT h, sum(g{n}) AS g, sum(e{n}) AS e, count(*) AS c FROM s{n} GROUP BY h), p{n} AS (SELECT h, sum(g) OVER w AS gl, sum(e) OVER w AS hl, sum(c) OVER w AS cl, sum(g) OVER () AS tg, sum(e) OVER () AS th, sum(c) OVER () AS tc FROM c{n} WINDOW w AS (ORDER BY h)),
        b{n} AS (SELECT *, gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1) AS gain FROM p{n} WHERE hl >= 1 AND th - hl >= 1 AND tc - cl >= 1 ORDER BY gain DESC, h LIMIT 1)"""

    step = lambda n: f"p + 0.5e0 * CASE WHEN s{n}.h <= b{n}.h THEN -gl / (hl + 1) ELSE -(tg - gl) / (th - hl + 1) END"
    return f"""WITH {EVENTS}, i AS (SELECT event_id, h, {label} AS y FROM ev), i0 AS (SELECT *, (SELECT {start} FROM i) AS p FROM i), s1 AS (SELECT *, {grad} AS g1, {hess} AS e1 FROM i0), {best(1)},
    j AS (SELECT event_id, s1.h, y, {step(1)} AS p FROM s1, b1), s2 AS (SELECT *, {grad} AS g2, {hess} AS e2 FROM j), {best(2)} SELECT event_id, round({step(2)}, {out}) AS raw FROM s2, b2"""


def _boost(spark, d, objective, label, digits, **params):
    p = {"dispatch.objective_name": objective, "booster.n_iters": 2, "booster.learning_rate": 0.5, "tree.max_depth": 1} | params
    e = events(spark, d)
    m = booster.train(p, e, ["h"], label, row_id="event_id")
    return m.raw(e).select("event_id", F.round("raw", digits).alias("raw"))


query(stumps("value::FLOAT::DOUBLE", "avg(y)", "p - y", "1.0e0", "3"), "boost_mse")(lambda s, d: _boost(s, d, "mse", "value", 3))
query(stumps("buy", "ln(avg(y) / (1 - avg(y)))", f"{SIGMOID.format('p')} - y", f"{SIGMOID.format('p')} * (1 - {SIGMOID.format('p')})", "5"), "boost_logloss")(lambda s, d: _boost(s, d, "logloss", "buy", 5))
query(stumps("k::DOUBLE", "ln(avg(y))", "exp(p) - y", "exp(p)", "5"), "boost_poisson")(lambda s, d: _boost(s, d, "poisson", "k", 5))


@query("SELECT 0 AS tree, round(1.5e0 * 1 / (1 + 0.5e0), 6) AS value UNION ALL SELECT 1, round(2.5e0 / (1 + 0.5e0), 6)")
def dart_round(spark, d):
    """One tree of value 1.5 dropped, a new one of value 2.5 grown: both scaled."""
    fresh, old = booster.dart_scales(1, 0.5)
    return spark.createDataFrame([(0, round(1.5 * old, 6)), (1, round(2.5 * fresh, 6))], "tree int, value double")


@query(EV + "true AS same FROM ev")
def warm_start(spark, d):
    """Two rounds, then two more from there, against four at once."""
    e = events(spark, d)
    p = {"booster.learning_rate": 0.3, "tree.max_depth": 2}
    fit = lambda n, m=None: booster.train(p | {"booster.n_iters": n}, e, NAMES, "value", row_id="event_id", init_model=m)
    a, b = fit(4), fit(2, fit(2))
    both = b.raw(a.raw(e, "a"), "b")
    return both.select("event_id", (F.abs(F.col("a") - F.col("b")) < 1e-6 * (1 + F.abs("a"))).alias("same"))


LOSSES = [5.0, 4.0, 4.5, 3.9, 3.95, 4.1, 4.2, 3.0]


@query("""WITH l AS (SELECT unnest(range(8)) AS i, unnest([5.0e0, 4.0, 4.5, 3.9, 3.95, 4.1, 4.2, 3.0]) AS loss), b AS (SELECT i, loss, min(loss) OVER (ORDER BY i) AS best FROM l),
t AS (SELECT b.i, b.loss, (SELECT min(x.i) FROM l x WHERE x.i <= b.i AND x.loss = b.best) AS best_round FROM b), s AS (SELECT min(i) AS stop FROM t WHERE i - best_round >= 3)
SELECT i, loss, best_round FROM t, s WHERE i <= coalesce(stop, 99)""")
def early_stop_trace(spark, d):
    patience, rows = booster.Patience(3), []
    for i, x in enumerate(LOSSES):
        done = patience.stop(x)
        rows.append((i, x, patience.at))
        if done:
            break
    return spark.createDataFrame(rows, "i long, loss double, best_round long")


@query("""WITH r(lib, seed, task, score) AS (VALUES ('a', 0, 't', 0.9), ('a', 1, 't', 0.8), ('b', 0, 't', 0.7), ('b', 1, 't', 0.95), ('c', 0, 't', 0.1), ('a', 0, 'u', 0.5), ('b', 0, 'u', 0.6), ('c', 0, 'u', 0.7)),
m AS (SELECT lib, task, avg(score) AS score FROM r GROUP BY lib, task), k AS (SELECT lib, task, rank() OVER (PARTITION BY task ORDER BY score DESC) AS rk FROM m)
SELECT lib, round(avg(rk), 4) AS mean_rank, count(*) FILTER (WHERE rk = 1) AS wins FROM k GROUP BY lib""")
def bench_standings(spark, d):
    from ..plans.standings import standings

    rows = [("a", 0, "t", 0.9), ("a", 1, "t", 0.8), ("b", 0, "t", 0.7), ("b", 1, "t", 0.95), ("c", 0, "t", 0.1), ("a", 0, "u", 0.5), ("b", 0, "u", 0.6), ("c", 0, "u", 0.7)]
    return standings(spark.createDataFrame(rows, "lib string, seed int, task string, score double"))


@query(EV + f"round({RAW}, 6) AS raw FROM ev")
def model_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    fixed().save(path)
    m = Model.load(path)
    return _r(m.raw(events(spark, d)), "raw")


QUERIES, ORACLE = query.queries, query.sql
