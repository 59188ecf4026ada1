"""Whole fits over orders, and their SQL: every round's histogram, split search, routing and scores unrolled.

Features a, b (with missing values) and c have fewer values than bins, so that cuts are exact.
"""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ..plans import booster
from .base import ORDERS, Catalog, key, orders
from .splits import search

query = Catalog()
NAMES = ["a", "b", "c"]
RATE, ROUNDS = 0.3, 2
KEYED = f"WITH {ORDERS}, long AS (SELECT id, 0 AS fid, a AS v FROM ord UNION ALL SELECT id, 1, b FROM ord UNION ALL SELECT id, 2, c FROM ord)"


def seeds(n: int) -> list[int]:
    """The samplers' seeds of the first rounds."""
    rng = random.Random(42)
    return [rng.randrange(1 << 20) for _ in range(n)]


def unrolled(depth: int = 2, leaves: int = 0, level: bool = False, rounds: int = ROUNDS, train: str = "true", sample=None, before=None, classes: int = 1) -> str:
    """CTEs up to s<rounds>: id, y, k and the scores p0, p1, ... after each round.

    Rows that ``train`` holds for make the cuts, the initial scores and the histograms; ``sample`` turns a round's
    number into a weight of the rows of g<round>, 0 for those that aren't drawn, after the CTEs of ``before``.
    """
    n_train = f"(SELECT count(*) FROM ord WHERE {train})"
    start = [f"(SELECT avg(y) FROM ord WHERE {train})"] if classes == 1 else [f"ln((SELECT greatest(count(*), 1) FROM ord WHERE {train} AND k = {c}) / {n_train}::DOUBLE)" for c in range(classes)]
    ctes = [
        KEYED, f"cut AS (SELECT fid, v, dense_rank() OVER (PARTITION BY fid ORDER BY v) - 1 AS bin FROM (SELECT DISTINCT fid, v FROM long JOIN ord USING (id) WHERE v IS NOT NULL AND {train}))",
        "nb AS (SELECT fid, count(*) + 2 AS n_bins FROM cut GROUP BY fid)",
        # A value that training lacks has the bin of the next one that it has.
        "binned AS MATERIALIZED (SELECT id, l.fid, CASE WHEN v IS NULL THEN n_bins - 1 ELSE (SELECT count(*) FROM cut c WHERE c.fid = l.fid AND c.v < l.v) END AS bin FROM long l JOIN nb USING (fid))",
        f"s0 AS MATERIALIZED (SELECT id, y, k, {', '.join(f'{x} AS p{c}' for c, x in enumerate(start))}, {train} AS own FROM ord)",
    ]
    side = "CASE WHEN CASE WHEN x.bin = nb.n_bins - 1 THEN {s}.dl ELSE x.bin <= {s}.bin END THEN {left} ELSE {right} END"
    for r in range(1, rounds + 1):
        if classes == 1:
            grads = [("p0 - y", "1.0e0")]
        else:
            whole = " + ".join(f"exp(p{c})" for c in range(classes))
            soft = [f"exp(p{c}) / ({whole})" for c in range(classes)]
            grads = [(f"{q} - CASE WHEN k = {c} THEN 1 ELSE 0 END", f"greatest({q} * (1 - {q}), 1e-6)") for c, q in enumerate(soft)]
        ctes.append(f"g{r} AS MATERIALIZED (SELECT id, own, {', '.join(f'{g} AS g{c}, {h} AS h{c}' for c, (g, h) in enumerate(grads))} FROM s{r - 1})")
        if before:
            ctes.append(before(r))
        for c in range(classes):
            t = f"{r}_{c}"
            weight = sample(r, f"g{c}") if sample else "1.0e0"
            ctes.append(f"w{t} AS MATERIALIZED (SELECT id, g{c} AS g, h{c} AS h, CASE WHEN own THEN {weight} ELSE 0 END AS w FROM g{r})")
            cells = lambda node, src: f"SELECT {node} AS node, b.fid, b.bin, sum(g * w) AS sg, sum(h * w) AS sh, count(*) AS cnt FROM w{t} JOIN binned b USING (id) {src} WHERE w > 0 GROUP BY ALL"  # noqa: E731, B023
            rows = 0 if level else 20
            ctes.append(f"h{t} AS ({cells('0', '')})")
            ctes.append(search(f"h{t}", f"s{t}", rows=rows))
            ctes.append(f"n{t} AS MATERIALIZED (SELECT x.id, {side.format(s='s', left=1, right=2)} AS node FROM s{t} s JOIN binned x ON x.fid = s.fid JOIN nb ON nb.fid = s.fid)")
            leaf = f"n{t}"
            if depth > 1:
                ctes.append(f"i{t} AS ({cells('n.node', f'JOIN n{t} n USING (id)')})")
                ctes.append(search(f"i{t}", f"t{t}", rows=rows, level=level))
                some = f"(SELECT * FROM t{t} ORDER BY gain DESC, node LIMIT 1)" if leaves == 3 else f"t{t}"
                on = "true" if level else "s.node = n.node"
                ctes.append(f"m{t} AS MATERIALIZED (SELECT n.id, CASE WHEN s.fid IS NULL THEN n.node * 10 ELSE n.node * 10 + {side.format(s='s', left=1, right=2)} END AS node FROM n{t} n LEFT JOIN {some} s ON {on} LEFT JOIN binned x ON x.id = n.id AND x.fid = s.fid LEFT JOIN nb ON nb.fid = s.fid)")
                leaf = f"m{t}"
            ctes.append(f"v{t} AS MATERIALIZED (SELECT node, -coalesce(sum(g * w) FILTER (WHERE w > 0), 0) / (coalesce(sum(h * w) FILTER (WHERE w > 0), 0) + 1) AS value FROM {leaf} JOIN w{t} USING (id) GROUP BY node)")
            ctes.append(f"l{t} AS (SELECT id, value FROM {leaf} JOIN v{t} USING (node))")
        joins = " ".join(f"JOIN l{r}_{c} l{c} ON l{c}.id = s.id" for c in range(classes))
        ctes.append(f"s{r} AS MATERIALIZED (SELECT s.id, y, k, {', '.join(f'p{c} + {RATE}e0 * l{c}.value AS p{c}' for c in range(classes))}, own FROM s{r - 1} s {joins})")
    return ",\n".join(ctes)


SHOWN = f" SELECT id, round(p0, 2) AS prediction FROM s{ROUNDS}"


def _fit(spark, d, **params):
    p = {"booster.n_iters": ROUNDS, "booster.learning_rate": RATE, "tree.max_depth": 2} | {k.replace("__", "."): v for k, v in params.items()}
    o = orders(spark, d)
    return booster.train(p, o, NAMES, "y", row_id="id").predict(o).select("id", F.round("prediction", 2).alias("prediction"))


query(unrolled() + SHOWN, "fit_depthwise")(lambda s, d: _fit(s, d))
query(unrolled(level=True) + SHOWN, "fit_levelwise")(lambda s, d: _fit(s, d, dispatch__grower_name="levelwise"))
query(unrolled(leaves=3) + SHOWN, "fit_leafwise")(lambda s, d: _fit(s, d, dispatch__grower_name="leafwise", tree__max_leaves=3))


def _bernoulli(r: int, g: str) -> str:
    return f"CASE WHEN {key('id', seeds(ROUNDS)[r - 1])} < 0.7 * 4294967296 THEN 1.0e0 ELSE 0 END"


query(unrolled(sample=_bernoulli) + SHOWN, "fit_bernoulli")(lambda s, d: _fit(s, d, dispatch__sampler_name="bernoulli", sampler__subsample=0.7))


def _goss(r: int, g: str) -> str:
    return f"(SELECT w FROM o{r} WHERE o{r}.id = g{r}.id)"


def _goss_ranks(r: int) -> str:
    """CTEs to o<r>: the weight of each row of round r."""
    return f"""t{r} AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY abs(g0) DESC, id) <= floor(0.2 * count(*) OVER () + 0.5) AS top, count(*) OVER () AS n FROM g{r}),
    o{r} AS MATERIALIZED (SELECT id, CASE WHEN top THEN 1.0e0 WHEN row_number() OVER (PARTITION BY top ORDER BY {key('id', seeds(ROUNDS)[r - 1])}, id) <= floor(0.1 * n + 0.5) THEN 0.8e0 / 0.1e0 ELSE 0 END AS w FROM t{r})"""


query(unrolled(sample=_goss, before=_goss_ranks) + SHOWN, "fit_goss")(lambda s, d: _fit(s, d, dispatch__sampler_name="goss"))


@query(unrolled(depth=1, classes=3) + f", e AS (SELECT id, [exp(p0), exp(p1), exp(p2)] AS e FROM s{ROUNDS}) SELECT id, round(e[1] / list_sum(e), 5) AS p0, round(e[2] / list_sum(e), 5) AS p1, list_position(e, list_max(e)) - 1 AS prediction FROM e")
def boost_softmax(spark, d):
    o = orders(spark, d)
    m = booster.train({"dispatch.objective_name": "softmax", "objective.n_classes": 3, "booster.n_iters": ROUNDS, "booster.learning_rate": RATE, "tree.max_depth": 1}, o, NAMES, "k", row_id="id")
    got = m.predict(m.predict_proba(o))
    return got.select("id", F.round(F.col("probability")[0], 5).alias("p0"), F.round(F.col("probability")[1], 5).alias("p1"), "prediction")


@query(unrolled(depth=1, rounds=1) + f", x AS (SELECT id, s0.p0 AS p, (s1.p0 - s0.p0) / {RATE}e0 AS v FROM s0 JOIN s1 USING (id)) SELECT id, round(p + {RATE}e0 * v * (1 / (2 + {RATE}e0) + 2 * 1 / (1 + {RATE}e0) * 2 / (2 + {RATE}e0)), 2) AS prediction FROM x")
def fit_dart(spark, d):
    """Three rounds that drop every tree: each grows the same stump from the initial score."""
    return _fit(spark, d, booster__dart_drop_rate=1.0, booster__n_iters=3, tree__max_depth=1)


LOSS = "SELECT {r} AS i, round(avg(pow(p0 - y, 2)) / 1e6, 4) AS loss FROM s{r} WHERE NOT own"


@query(unrolled(rounds=3, train="id % 5 <> 0") + " " + " UNION ALL ".join(LOSS.format(r=r) for r in (1, 2, 3)))
def fit_early_stopping(spark, d):
    """The history of an evaluation set; no round is so much worse that training stops."""
    o, losses = orders(spark, d), []
    p = {"booster.early_stopping_rounds": 3, "booster.n_iters": 3, "booster.learning_rate": RATE, "tree.max_depth": 2}
    booster.train(p, o.where("id % 5 <> 0"), NAMES, "y", row_id="id", eval_set=o.where("id % 5 = 0"), on_round=lambda i, x: losses.append(x))
    return spark.createDataFrame([(i + 1, round(x / 1e6, 4)) for i, x in enumerate(losses)], "i int, loss double")


QUERIES, ORACLE = query.queries, query.sql
