"""Sources, cuts, bins, samples and encodings."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BinMapper, Config, Data
from ..functions.ranking import order_key, shared_dir
from ..operators import binning as B
from ..operators import encoding as E
from ..operators import samplers
from ..plans import booster
from ..plans.dataset import BinnedDataset
from ..sources import tables, text
from .base import EVENTS, LINES, Catalog, events, key, lines, table

query = Catalog()


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"


def _uniform(column: str) -> str:
    return f"(('0x' || substr(md5(row_id || ':' || {column} || ':42'), 1, 8))::BIGINT / 4294967296.0e0)"


@query(f"""WITH x AS (SELECT row_id, {', '.join(f'{_uniform(str(i))}::FLOAT AS f{i}' for i in range(10))}, greatest({_uniform("'a'")}, 1e-12) AS u1, {_uniform("'b'")} AS u2 FROM (SELECT unnest(range(2000)) AS row_id)),
s AS (SELECT *, {' + '.join(f"{0.6**b}e0 * (10 * sin(pi() * f{5 * b}::DOUBLE * f{5 * b + 1}::DOUBLE) + 20 * pow(f{5 * b + 2}::DOUBLE - 0.5, 2) + 10 * f{5 * b + 3}::DOUBLE + 5 * f{5 * b + 4}::DOUBLE)" for b in range(2))} AS s FROM x)
SELECT row_id, {', '.join(f'round(f{i}::DOUBLE, 5) AS f{i}' for i in range(10))}, round(s + (SELECT stddev_pop(s) FROM s) / 3 * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2), 3) AS label FROM s""")
def gen_friedman(spark, d):
    got = tables.friedman(spark, 2000, 10)
    return got.select("row_id", *[F.round(F.col(f"f{i}").cast("double"), 5).alias(f"f{i}") for i in range(10)], F.round("label", 3).alias("label"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) > count(*) OVER () - greatest(1, (count(*) OVER () * 2) // 10) AS is_eval FROM orders")
def holdout_split(spark, d):
    return tables.holdout(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def cat_codes(spark, d):
    return tables.category_codes(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", F.col("code").cast("long").alias("code"))


@query(f"WITH {EVENTS} SELECT round(buy, 4) AS label, round(h::DOUBLE, 4) AS h, round(k::DOUBLE, 4) AS k FROM ev")
def src_csv(spark, d):
    path = _scratch(spark)
    events(spark, d).select(F.concat_ws(",", F.col("buy").cast("int"), F.concat(F.lit(" "), F.col("h").cast("string")), F.coalesce(F.col("k").cast("string"), F.lit("nan")))).write.text(path)
    got = text.read_csv(spark, path, Data(header=False))
    return got.select(*[F.round(F.col(a).cast("double"), 4).alias(b) for a, b in (("label", "label"), ("f1", "h"), ("f2", "k"))])


@query("SELECT round(l_extendedprice::FLOAT::DOUBLE, 2) AS label, round((l_quantity)::FLOAT::DOUBLE, 4) AS weight, round(l_discount::FLOAT::DOUBLE, 4) AS disc FROM lineitem")
def src_roles(spark, d):
    path = _scratch(spark)
    cols = ["l_discount", "l_orderkey", "l_extendedprice", "l_quantity"]
    table(spark, d, "lineitem").select(F.concat_ws(",", *[F.col(c).cast("string") for c in cols])).write.text(path)
    got = text.read_csv(spark, path, Data(header=False, label_column=2, weight_column=3, ignored_columns=[1]))
    return got.select(F.round(F.col("label").cast("double"), 2).alias("label"), F.round(F.col("weight").cast("double"), 4).alias("weight"), F.round(F.col("f0").cast("double"), 4).alias("disc"))


@query(f"WITH {EVENTS} SELECT buy AS label, h::DOUBLE AS f0, 0.0e0 AS f1, k::DOUBLE AS f2 FROM ev")
def src_libsvm(spark, d):
    path = _scratch(spark)
    e = events(spark, d)
    rows = e.select(F.concat_ws(" ", F.col("buy").cast("int"), F.when(F.col("h") != 0, F.concat(F.lit("1:"), "h")), F.concat(F.lit("3:"), "k")))
    rows.write.text(path)
    return text.read_libsvm(spark, path, 3).select(*[F.col(c).cast("double").alias(c) for c in ("label", "f0", "f1", "f2")])


@query(f"SELECT event_id FROM events ORDER BY {key('event_id', 7)} LIMIT 3000")
def bin_sample(spark, d):
    return B.sample_rows(table(spark, d, "events").select("event_id"), 3000, "event_id", 7)


LONG = "long AS (SELECT 0 AS fid, q AS v FROM lines UNION ALL SELECT 1, d FROM lines UNION ALL SELECT 2, t FROM lines)"


@query(f"WITH {LINES}, {LONG} SELECT fid, v::DOUBLE AS v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL")
def cut_rle(spark, d):
    return B.run_lengths(lines(spark, d), ["q", "d", "t"]).withColumn("v", F.col("v").cast("double"))


def _cuts_frame(spark, cuts: B.Cuts) -> DataFrame:
    rows = [(i, j, float(x)) for i, c in enumerate(cuts.cuts) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "fid int, bin long, cut double")


@query(f"""WITH {LINES}, {LONG}, u AS (SELECT DISTINCT fid, v FROM long WHERE v IS NOT NULL), n AS (SELECT fid, count(*) AS c FROM u GROUP BY fid)
SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY v) - 1 AS bin, v::DOUBLE AS cut FROM u
UNION ALL SELECT fid, c, 340282346638528859811704183484516925440.0::FLOAT::DOUBLE FROM n UNION ALL SELECT fid, c + 1, 'inf'::DOUBLE FROM n""")
def cuts_exact(spark, d):
    return _cuts_frame(spark, B.fit_cuts(lines(spark, d), ["q", "d", "t"], BinMapper()))


@query("""WITH s AS (SELECT l_extendedprice::FLOAT AS v, row_number() OVER (ORDER BY l_extendedprice::FLOAT) - 1 AS rn, count(*) OVER () AS n FROM lineitem),
u AS (SELECT DISTINCT v FROM s WHERE rn > 0 AND rn % greatest((n + 253) // 254, 1) = 0)
SELECT 0 AS fid, row_number() OVER (ORDER BY v) - 1 AS bin, v::DOUBLE AS cut FROM u UNION ALL SELECT 0, (SELECT count(*) FROM u), 340282346638528859811704183484516925440.0::FLOAT::DOUBLE UNION ALL SELECT 0, (SELECT count(*) + 1 FROM u), 'inf'::DOUBLE""")
def cuts_stride(spark, d):
    src = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"))
    return _cuts_frame(spark, B.fit_cuts(src, ["x"], BinMapper(n_samples=1 << 30)))


@query("SELECT 0 AS fid, unnest([0::BIGINT, 1, 2, 3, 4]) AS bin, unnest([10.0::DOUBLE, 20.0, 40.0, 340282346638528859811704183484516925440.0::FLOAT::DOUBLE, 'inf'::DOUBLE]) AS cut")
def cuts_edges(spark, d):
    return _cuts_frame(spark, B.fit_cuts(lines(spark, d), ["q"], BinMapper(), edges={"q": [10.0, 20.0, 40.0]}))


HEAVY = "CASE WHEN event_id % 3 = 0 THEN 0.0e0 ELSE value END::FLOAT"


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM events), v0 AS (SELECT {HEAVY} AS v, count(*) AS c FROM events GROUP BY 1),
v AS MATERIALIZED (SELECT v, c, row_number() OVER (ORDER BY v) AS i, sum(c) OVER (ORDER BY v) AS ends, c * 63 >= n AS heavy, lead(c * 63 >= n, 1, false) OVER (ORDER BY v) AS before_heavy, lead(v) OVER (ORDER BY v) AS next,
    sum(CASE WHEN c * 63 >= n THEN 0 ELSE c END) OVER (ORDER BY v) AS light FROM v0, n),
k AS (SELECT greatest(1, 63 - count(*) FILTER (WHERE heavy)) AS shares, max(light) AS light, max(i) AS last FROM v),
b(i, shares, size, made) AS (SELECT 0::BIGINT, shares::BIGINT, light::DOUBLE / shares, 0 FROM k UNION ALL
    SELECT x.i, CASE WHEN NOT x.heavy AND b.shares > 1 THEN b.shares - 1 ELSE b.shares END, CASE WHEN NOT x.heavy AND b.shares > 1 THEN (SELECT light FROM k) - x.light ELSE b.size * CASE WHEN NOT x.heavy AND b.shares > 1 THEN b.shares - 1 ELSE 1 END END / CASE WHEN NOT x.heavy AND b.shares > 1 THEN b.shares - 1 ELSE 1 END, b.made + 1
    FROM b, v x WHERE b.made < 62 AND x.i < (SELECT last FROM k) AND x.i = (SELECT min(y.i) FROM v y WHERE y.i > b.i AND (y.heavy OR y.ends - coalesce((SELECT z.ends FROM v z WHERE z.i = b.i), 0) >= b.size OR (y.before_heavy AND y.ends - coalesce((SELECT z.ends FROM v z WHERE z.i = b.i), 0) >= greatest(1, b.size / 2))))),
u AS (SELECT DISTINCT ((v.v::DOUBLE + v.next::DOUBLE) / 2)::FLOAT AS v FROM b JOIN v USING (i) WHERE b.i > 0)
SELECT 0 AS fid, row_number() OVER (ORDER BY v) - 1 AS bin, v::DOUBLE AS cut FROM u UNION ALL SELECT 0, (SELECT count(*) FROM u), 340282346638528859811704183484516925440.0::FLOAT::DOUBLE UNION ALL SELECT 0, (SELECT count(*) + 1 FROM u), 'inf'::DOUBLE""")
def cuts_greedy(spark, d):
    src = table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value")).alias("x"))
    return _cuts_frame(spark, B.fit_cuts(src, ["x"], BinMapper(max_bin=64)))


EDGES = [2.5, 10.0, 25.0, 50.0, 75.0]
CASE = "CASE WHEN v IS NULL THEN 6 WHEN v <= 2.5 THEN 0 WHEN v <= 10 THEN 1 WHEN v <= 25 THEN 2 WHEN v <= 50 THEN 3 WHEN v <= 75 THEN 4 ELSE 5 END"


@query(f"WITH {EVENTS} SELECT event_id, {CASE} AS bin FROM ev")
def bin_transform(spark, d):
    return events(spark, d).select("event_id", B.bin_column(F.col("v"), B.edges_to_cuts(EDGES)).cast("int").alias("bin"))


@query(f"WITH {EVENTS} SELECT event_id, {CASE} AS b0, (dense_rank() OVER (ORDER BY h) - 1)::INT AS b1 FROM ev")
def bin_table(spark, d):
    e = events(spark, d)
    cuts = B.fit_cuts(e, ["v", "h"], BinMapper(), edges={"v": EDGES})
    return B.bin_table(e, cuts, ["event_id"]).select("event_id", F.col("b0").cast("int").alias("b0"), F.col("b1").cast("int").alias("b1"))


@query(f"WITH {EVENTS} SELECT event_id, {CASE} AS b0, (dense_rank() OVER (ORDER BY h) - 1)::INT AS b1 FROM ev")
def bin_arrays(spark, d):
    e = events(spark, d)
    cuts = B.fit_cuts(e, ["v", "h"], BinMapper(), edges={"v": EDGES})
    return B.bin_arrays(e, cuts, ["event_id"]).select("event_id", F.col("bins")[0].alias("b0"), F.col("bins")[1].alias("b1"))


@query(f"WITH {EVENTS} SELECT event_id, {CASE} AS bin FROM ev WHERE v IS NOT NULL")
def bin_range_join(spark, d):
    e = events(spark, d).where("v is not null")
    r = F.broadcast(B.cut_ranges(spark, B.edges_to_cuts(EDGES)))  # a row for each cut
    return e.join(r, (F.col("v") > F.col("lo")) & (F.col("v") <= F.col("hi"))).select("event_id", "bin")


def _drawn(spark, d, seed, **sampler):
    """(event_id, g, h) of the rows that a sampler draws at the score 50 for the label value, as training draws them."""
    c = Config()
    for k, v in sampler.items():
        setattr(c.dispatch if k == "sampler_name" else c.sampler, k, v)
    ds = BinnedDataset(events(spark, d), ["h"], "value", row_id="event_id")
    scores, n = booster._Scores(ds, [50.0], [], 1.0), booster.labels(ds).count()
    prepare, read = booster.sampler(scores.df, scores.read, c, booster.objectives.of(c), seed, n), scores.read

    def run(batches):
        for batch in batches:
            for b in read(batch):
                g, h, rows = prepare(b)[0]
                yield pa.RecordBatch.from_arrays([pa.array(b.rid[rows]), pa.array(g[rows]), pa.array(np.ones(len(rows)) if h is None else h[rows])], ["event_id", "g", "h"])

    return scores.df.mapInArrow(run, "event_id long, g double, h double")


@query(f"SELECT event_id FROM events WHERE {key('event_id', 3)} < 0.3 * 4294967296")
def sample_bernoulli(spark, d):
    return _drawn(spark, d, 3, sampler_name="bernoulli", subsample=0.3).select("event_id")


GRAD = "g0 AS (SELECT event_id, 50.0e0 - value::FLOAT::DOUBLE AS g FROM events), n AS (SELECT count(*) AS n FROM g0), r AS (SELECT *, row_number() OVER (ORDER BY abs(g) DESC, event_id) AS rn FROM g0, n)"


@query(f"WITH {GRAD} SELECT event_id, round(g, 4) AS g FROM r WHERE rn <= floor(0.2 * n + 0.5)")
def goss_top(spark, d):
    return _drawn(spark, d, 5, sampler_name="goss").where("h = 1").select("event_id", F.round("g", 4).alias("g"))


@query(f"WITH {GRAD}, o AS (SELECT *, row_number() OVER (ORDER BY {key('event_id', 5)}, event_id) AS o FROM r WHERE rn > floor(0.2 * n + 0.5)) SELECT event_id, round(g * (1 - 0.2e0) / 0.1e0, 4) AS g, round((1 - 0.2e0) / 0.1e0, 4) AS h FROM o WHERE o <= floor(0.1 * n + 0.5)")
def goss_rest(spark, d):
    return _drawn(spark, d, 5, sampler_name="goss").where("h > 1").select("event_id", F.round("g", 4).alias("g"), F.round("h", 4).alias("h"))


@query(f"SELECT fid FROM (SELECT unnest(range(10)) AS fid) ORDER BY {key('fid', 2)} LIMIT 3")
def feature_fraction(spark, d):
    return spark.createDataFrame([(i,) for i in samplers.feature_subset(10, 0.25, 2)], "fid long")


# Encodings: target o_orderstatus = 'F' by priority and by customer.
O = "o AS (SELECT o_orderkey, o_orderpriority AS p, (o_custkey % 50)::DOUBLE AS c, CASE WHEN o_orderstatus = 'F' THEN 1.0e0 ELSE 0.0e0 END AS y FROM orders), mu AS (SELECT avg(y) AS prior FROM o)"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 50).cast("double").alias("c"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))


@query(f"WITH {O} SELECT p, round((sum(y) + 10 * any_value(prior)) / (count(*) + 10), 6) AS value FROM o, mu GROUP BY p")
def te_full_stats(spark, d):
    return E.full_stats(_orders(spark, d), "p", "y").withColumn("value", F.round("value", 6))


@query(f"WITH {O}, s AS (SELECT c, (sum(y) + 10 * any_value(prior)) / (count(*) + 10) AS value FROM o, mu WHERE o_orderkey % 2 = 0 AND c < 40 GROUP BY c), pr AS (SELECT avg(y) AS prior FROM o WHERE o_orderkey % 2 = 0 AND c < 40), s2 AS (SELECT c, (sum(y) + 10 * (SELECT prior FROM pr)) / (count(*) + 10) AS value FROM o WHERE o_orderkey % 2 = 0 AND c < 40 GROUP BY c) SELECT o_orderkey, round(coalesce(value, (SELECT prior FROM pr)), 6) AS te FROM o LEFT JOIN s2 USING (c) WHERE o_orderkey % 2 = 1")
def te_transform(spark, d):
    o = _orders(spark, d)
    enc = E.OrderedTargetEncoder(["c"], keep_codes=False)
    enc.fit_transform(o.where("o_orderkey % 2 = 0 AND c < 40").select("o_orderkey", "c", "y"), "y", "o_orderkey")
    return enc.transform(o.where("o_orderkey % 2 = 1").select("o_orderkey", "c")).select("o_orderkey", F.round("c_te", 6).alias("te"))


def _te(cat: str, seed: int, as_: str) -> str:
    w = f"OVER (PARTITION BY {cat} ORDER BY {key('o_orderkey', seed)}, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"(coalesce(sum(y) {w}, 0) + 10 * prior) / (count(*) {w} + 10) AS {as_}"


@query(f"WITH {O} SELECT o_orderkey, round(te, 6) AS te FROM (SELECT o_orderkey, {_te('p', 0, 'te')} FROM o, mu)")
def te_ordered(spark, d):
    return E.ordered(_orders(spark, d), "p", "y", "o_orderkey").select("o_orderkey", F.round("te", 6).alias("te"))


@query(f"WITH {O} SELECT o_orderkey, round((a + b + c3) / 3, 6) AS te FROM (SELECT o_orderkey, {_te('c', 1, 'a')}, {_te('c', 2, 'b')}, {_te('c', 3, 'c3')} FROM o, mu)")
def te_multi_perm(spark, d):
    enc = E.OrderedTargetEncoder(["c"], n_permutations=3, seed=1, keep_codes=False)
    return enc.fit_transform(_orders(spark, d).select("o_orderkey", "c", "y"), "y", "o_orderkey").select("o_orderkey", F.round("c_te", 6).alias("te"))


@query(f"WITH {O} SELECT o_orderkey, round(te, 6) AS te FROM (SELECT o_orderkey, {_te('c, o_orderkey % 3', 0, 'te')} FROM o, mu)")
def te_pairs(spark, d):
    o = _orders(spark, d).withColumn("b", (F.col("o_orderkey") % 3).cast("double"))
    enc = E.OrderedTargetEncoder(["c", "b"], cross=2, keep_codes=False)
    return enc.fit_transform(o.select("o_orderkey", "c", "b", "y"), "y", "o_orderkey").select("o_orderkey", F.round("c_b_te", 6).alias("te"))


@query(f"SELECT o_orderkey, {key('o_orderkey', 1)}::BIGINT AS k FROM orders")
def order_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", order_key("o_orderkey", 1).alias("k"))


QUERIES, ORACLE = query.queries, query.sql
