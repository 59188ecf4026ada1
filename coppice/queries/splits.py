"""Histograms, split search, routing and trees over lineitem, by what training runs: features q, d (with missing values), t."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..config import Config, Tree
from ..operators import histogram as H
from ..operators import routing as R
from ..operators import split as S
from ..plans import booster, growers
from ..plans.search import Build, Search
from ..plans.dataset import BinnedDataset
from ..plans.trees import Tree as Nodes
from .base import LINES, Catalog, lines

query = Catalog()
NAMES = ["q", "d", "t"]
ALL = np.ones(3, bool)


class _Start:
    """A search at the mean score, and a tree whose root is split at q <= 24 into nodes 1 and 2; exact cuts."""

    def __init__(self, spark, d, weight=None, **config):
        self.spark, self.config = spark, Tree(**config)
        self.ds = BinnedDataset(lines(spark, d), NAMES, "y", weight)
        self.cuts, self.n_bins, self.last = self.ds.cuts.cuts, self.ds.cuts.n_bins, self.ds.cuts.n_bins - 1
        c = Config(tree=self.config)
        objective = booster.objectives.of(c)
        self.scores = booster._Scores(self.ds, [objective.init_score(booster.labels(self.ds))], [], 1.0)
        prepare = booster.sampler(self.scores.df, self.scores.read, c, objective, 0, 0)
        self.search = Search(self.scores.df, self.scores.read, prepare, self.config, self.n_bins, [ALL], 4)
        self.tree = Nodes()
        self.tree.add(0.0)
        self.tree.split(0, 0, self.at(0, 24), 24.0, True, 0.0, (0.0, 0.0))

    def at(self, fid, x):
        return int(np.searchsorted(self.cuts[fid], np.float32(x)))

    def cells(self, *nodes):
        """{node: cells}; the root alone before it is split."""
        tree = self.tree
        if nodes == (0,):
            tree = Nodes()
            tree.add(0.0)
        return self.search.cells([Build(0, tree.arrays(), list(nodes))])[0]

    def show(self, cells):
        rows = [(n, int(f), int(b), *map(float, c[f, b, :2]), int(c[f, b, 2])) for n, c in cells.items() for f, b in zip(*np.nonzero(c[..., 2]))]
        df = self.spark.createDataFrame(rows, "node int, fid int, bin int, sg double, sh double, cnt long")
        return df.select("node", "fid", "bin", F.round("sg", 2).alias("sg"), F.round("sh", 3).alias("sh"), "cnt")

    def splits(self, found):
        rows = [(n, s.fid, s.bin, s.default_left, round(s.gain / 1000, 1), s.left[2]) for n, s in found.items() if s]
        return self.spark.createDataFrame(rows, "node int, fid int, bin int, default_left boolean, gain double, n_left long")

    def rows(self, emit, schema):
        """What ``emit`` makes of each block."""
        read = self.scores.read

        def run(batches):
            for batch in batches:
                for b in read(batch):
                    yield emit(b)

        return self.scores.df.mapInArrow(run, schema)


# SQL of the same from the exact rule: a value's bin is its place among the distinct ones, missing values
# have the last of n + 2 bins.
AS_FLOAT = LINES.replace("l_extendedprice AS y", "l_extendedprice::FLOAT::DOUBLE AS y")  # labels are floats in the engine
BINS = f"""{AS_FLOAT}, mu AS (SELECT avg(y) AS mu FROM lines), rows0 AS (SELECT *, mu - y AS g, row_number() OVER () AS id, CASE WHEN q <= 24 THEN 1 ELSE 2 END AS half FROM lines, mu),
long AS (SELECT id, half, g, 0 AS fid, q AS v FROM rows0 UNION ALL SELECT id, half, g, 1, d FROM rows0 UNION ALL SELECT id, half, g, 2, t FROM rows0),
cut AS (SELECT fid, v, dense_rank() OVER (PARTITION BY fid ORDER BY v) - 1 AS bin FROM (SELECT DISTINCT fid, v FROM long WHERE v IS NOT NULL)),
nb AS (SELECT fid, count(*) + 2 AS n_bins FROM cut GROUP BY fid)"""


def hist(name: str, node: str, where: str = "true") -> str:
    return f"{name} AS (SELECT {node} AS node, l.fid, coalesce(c.bin, nb.n_bins - 1) AS bin, sum(g) AS sg, count(*)::DOUBLE AS sh, count(*) AS cnt FROM long l JOIN nb ON nb.fid = l.fid LEFT JOIN cut c ON c.fid = l.fid AND c.v = l.v WHERE {where} GROUP BY ALL)"


def soft(g: str, l1: float) -> str:
    return f"(CASE WHEN {g} > {l1} THEN {g} - {l1} WHEN {g} < -{l1} THEN {g} + {l1} ELSE 0 END)" if l1 else g


def search(of: str, name: str, l1: float = 0.0, l2: float = 1.0, least: float = 1.0, rows: int = 20, gain: float = 0.0, more: str = "true", level: bool = False) -> str:
    """CTEs from histogram ``of`` to ``name``: node, fid, bin, default_left, gain and both sides' sums."""
    sc = lambda g, h: f"({soft(g, l1)} * {soft(g, l1)} / ({h} + {l2}))"
    part = "" if level else "PARTITION BY node"
    pick = "SELECT fid, bin, dl, sum(gain) AS gain FROM {n}_c GROUP BY fid, bin, dl" if level else "SELECT * FROM {n}_c"
    return f"""{name}_p AS (SELECT h.*, n_bins, sum(sg) OVER w AS tg, sum(sh) OVER w AS th, sum(cnt) OVER w AS tc, coalesce(sum(CASE WHEN bin = n_bins - 1 THEN sg END) OVER w, 0) AS mg, coalesce(sum(CASE WHEN bin = n_bins - 1 THEN sh END) OVER w, 0) AS mh, coalesce(sum(CASE WHEN bin = n_bins - 1 THEN cnt END) OVER w, 0) AS mc
        FROM {of} h JOIN nb USING (fid) WINDOW w AS (PARTITION BY node, fid)),
    {name}_r AS (SELECT *, sum(sg) OVER w AS gl, sum(sh) OVER w AS hl, sum(cnt) OVER w AS cl FROM {name}_p WHERE bin < n_bins - 1 WINDOW w AS (PARTITION BY node, fid ORDER BY bin)),
    {name}_d AS (SELECT *, dl, gl + CASE WHEN dl THEN mg ELSE 0 END AS GL_, hl + CASE WHEN dl THEN mh ELSE 0 END AS HL_, cl + CASE WHEN dl THEN mc ELSE 0 END AS CL_ FROM {name}_r, (SELECT unnest([true, false]) AS dl) WHERE bin <= n_bins - 3 AND (dl OR mc > 0)),
    {name}_c AS (SELECT *, {sc('GL_', 'HL_')} + {sc('(tg - GL_)', '(th - HL_)')} - {sc('tg', 'th')} AS gain FROM {name}_d WHERE HL_ >= {least} AND th - HL_ >= {least} AND CL_ >= 1 AND tc - CL_ >= 1 AND tc >= {2 * rows} AND {more}),
    {name} AS (SELECT *, row_number() OVER ({part} ORDER BY gain DESC, fid, bin, dl DESC) AS rn FROM ({pick.format(n=name)}) WHERE gain > 0 AND gain >= {gain} QUALIFY rn = 1)"""


SHOW = "node::INT AS node, fid::INT AS fid, bin::INT AS bin, dl AS default_left, round(gain / 1000, 1) AS gain, CL_::BIGINT AS n_left"


CELLS = "node::INT AS node, fid::INT AS fid, bin::INT AS bin, round(sg, 2) AS sg, sh, cnt"
WEIGHTED = """hw AS (SELECT 0 AS node, l.fid, coalesce(c.bin, nb.n_bins - 1) AS bin, sum(g * wf) AS sg, sum(wf) AS sh, count(*) AS cnt FROM (SELECT l.*, r.w::FLOAT::DOUBLE AS wf FROM long l JOIN rows0 r USING (id)) l
    JOIN nb ON nb.fid = l.fid LEFT JOIN cut c ON c.fid = l.fid AND c.v = l.v GROUP BY ALL)"""


@query(f"WITH {BINS}, {WEIGHTED} SELECT node, fid::INT AS fid, bin::INT AS bin, round(sg, 2) AS sg, round(sh, 3) AS sh, cnt FROM hw")
def hist_root(spark, d):
    """Weighted rows: hessians are summed."""
    x = _Start(spark, d, "w")
    return x.show(x.cells(0))


@query(f"WITH {BINS}, {hist('h', '0')} SELECT {CELLS} FROM h")
def hist_unit_hess(spark, d):
    """Hessians of 1: their sums are the counts."""
    x = _Start(spark, d)
    return x.show(x.cells(0))


@query(f"WITH {BINS}, {hist('h', 'half')} SELECT {CELLS} FROM h")
def hist_level(spark, d):
    x = _Start(spark, d)
    return x.show(x.cells(1, 2))


@query(f"WITH {BINS}, {hist('h', '2', 'half = 2')} SELECT {CELLS} FROM h")
def hist_subtract(spark, d):
    x = _Start(spark, d)
    return x.show({2: H.subtract(x.cells(0)[0], x.cells(1)[1])})


@query(f"WITH {BINS}, {hist('h', '0')} SELECT {CELLS} FROM h")
def hist_arrow(spark, d):
    """The partial sums of many partitions: added up by tiles of features, in groups of partitions."""
    x = _Start(spark, d)
    x.search.n_parts = 1 << 20
    return x.show(x.cells(0))


@query(f"WITH {BINS} SELECT half AS node, round(sum(g), 2) AS tg, count(*)::DOUBLE AS th, count(*) AS n FROM rows0 GROUP BY half")
def node_totals(spark, d):
    x = _Start(spark, d)
    rows = [(n, round(g, 2), h, k) for n, c in x.cells(1, 2).items() for g, h, k in [H.totals(c)]]
    return spark.createDataFrame(rows, "node int, tg double, th double, n long")


@query(f"WITH {BINS} SELECT half AS node, round(-sum(g) / (count(*) + 1), 6) AS value FROM rows0 GROUP BY half")
def leaf_values(spark, d):
    x = _Start(spark, d)
    rows = [(n, round(float(S.np_weight(*H.totals(c, 2)[:2], 0.0, 1.0)), 6)) for n, c in x.cells(1, 2).items()]
    return spark.createDataFrame(rows, "node int, value double")


@query(f"WITH {BINS}, {hist('h', '0')}, {search('h', 's')} SELECT node::INT AS node, fid::INT AS fid, bin::INT AS bin, round(gl, 2) AS gl, hl, round(mg, 2) AS mg, mh FROM s_r")
def split_prefix(spark, d):
    x = _Start(spark, d)
    cells = x.cells(0)[0]
    c = S.Candidates.of(cells, x.n_bins, x.config)
    rows = []
    for f, b in zip(*np.nonzero(cells[..., 2])):
        if b < x.last[f]:
            run, miss = c.left[f, b, 1], c.left[f, b, 0] - c.left[f, b, 1]
            rows.append((0, int(f), int(b), round(float(run[0]), 2), float(run[1]), round(float(miss[0]), 2), float(miss[1])))
    return spark.createDataFrame(rows, "node int, fid int, bin int, gl double, hl double, mg double, mh double")


@query(f"WITH {BINS}, {hist('h', '0')}, {search('h', 's')} SELECT {SHOW} FROM s_c")
def split_missing(spark, d):
    x = _Start(spark, d)
    c = S.Candidates.of(x.cells(0)[0], x.n_bins, x.config)
    rows = [(0, int(f), int(b), bool(k == 0), round(float(c.gain[f, b, k]) / 1000, 1), int(round(c.left[f, b, k, 2]))) for f, b, k in zip(*np.nonzero(c.ok))]
    return spark.createDataFrame(rows, "node int, fid int, bin int, default_left boolean, gain double, n_left long")


@query(f"WITH {BINS}, {hist('h', 'half')}, {search('h', 's')} SELECT {SHOW} FROM s")
def split_best(spark, d):
    x = _Start(spark, d)
    return x.splits({n: S.find(c, x.n_bins, x.config) for n, c in x.cells(1, 2).items()})


@query(f"WITH {BINS}, {hist('h', 'half')}, {search('h', 's')} SELECT {SHOW} FROM s")
def split_far(spark, d):
    """The same, summed and searched on the executors, as levels are whose cells outgrow the driver."""
    x = _Start(spark, d)
    x.search.driver_cells = 0
    found = x.search.answer({0: growers.Ask(x.tree, [(0, 1, 2)], {n: (ALL, -np.inf, np.inf) for n in (1, 2)})})
    return x.splits(found[0].splits)


@query(f"WITH {BINS}, {hist('h', 'half')}, {search('h', 's', 50000.0, 10.0, 500.0, 100, 1000.0)} SELECT {SHOW} FROM s")
def split_regularized(spark, d):
    x = _Start(spark, d, lambda_l1=50000.0, lambda_l2=10.0, min_child_hess=500.0, min_data_in_leaf=100, min_gain_to_split=1000.0)
    return x.splits({n: S.find(c, x.n_bins, x.config) for n, c in x.cells(1, 2).items()})


W = "greatest(-2000, least(2000, -({}) / ({} + 1.0)))"
SIGN = "CASE fid WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END"
MONOTONE = f"({SIGN}) * ({W.format('tg - GL_', 'th - HL_')} - {W.format('GL_', 'HL_')}) >= 0"


@query(f"WITH {BINS}, {hist('h', 'half')}, {search('h', 's', more=MONOTONE)} SELECT {SHOW} FROM s")
def split_monotone(spark, d):
    x = _Start(spark, d, monotone_constraints=[1, -1, 0])
    return x.splits({n: S.find(c, x.n_bins, x.config, None, -2000.0, 2000.0, x.search.sign) for n, c in x.cells(1, 2).items()})


@query(f"WITH {BINS}, {hist('h', 'half')}, {search('h', 's', more='fid < 2')} SELECT {SHOW} FROM s")
def split_interaction(spark, d):
    """Below a split by q only its group's features split: q and d."""
    x = _Start(spark, d, interaction_constraints=["0,1", "1+2"])
    front = growers._Frontier(x.config, x.cuts, ALL)
    front.split(0, S.Split(1.0, 0, x.at(0, 24), True, (0.0, 1.0, 1), (0.0, 1.0, 1)))
    return x.splits({n: S.find(c, x.n_bins, x.config, *front.limits(n)) for n, c in x.cells(1, 2).items()})


@query(f"WITH {BINS}, {hist('h', 'half')}, {search('h', 's', rows=0, level=True)} SELECT fid::INT AS fid, bin::INT AS bin, dl AS default_left, round(gain / 1000, 1) AS gain FROM s")
def split_level(spark, d):
    x = _Start(spark, d)
    return x.splits({1: S.find_level(list(x.cells(1, 2).values()), x.n_bins, x.config)[0]}).drop("node", "n_left")


@query(f"WITH {LINES} SELECT q::DOUBLE AS q, d::DOUBLE AS d, coalesce(d <= 0.04::FLOAT, true) AS goes_left FROM lines")
def route_rows(spark, d):
    return lines(spark, d).select(F.col("q").cast("double").alias("q"), F.col("d").cast("double").alias("d"), R.raw_goes_left(F.col("d"), 0.04, True).alias("goes_left"))


NEXT = "CASE WHEN q <= 24 THEN CASE WHEN coalesce(d <= 0.03::FLOAT, false) THEN 3 ELSE 4 END ELSE CASE WHEN t <= 0.05::FLOAT THEN 5 ELSE 6 END END"


def _routed(spark, d, least=0.0):
    """(node, y) of the rows of a quantity above ``least``, through a tree of depth two."""
    x = _Start(spark, d)
    for n, fid, value, default_left in ((1, 1, 0.03, False), (2, 2, 0.05, True)):
        x.tree.split(n, fid, x.at(fid, value), value, default_left, 0.0, (0.0, 0.0))
    t, last, above = x.tree.arrays(), x.last, x.at(0, least)

    def emit(b):
        some = b.bins[0] > above if least else np.ones(len(b), bool)
        return pa.RecordBatch.from_arrays([pa.array(R.leaf_of_bins(t, b.bins, last)[some]), pa.array(b.label[some].astype(np.float64))], ["node", "y"])

    return x.rows(emit, "node int, y double")


@query(f"WITH {AS_FLOAT} SELECT {NEXT} AS node, count(*) AS n, round(sum(y), 2) AS y FROM lines GROUP BY 1")
def partition_level(spark, d):
    return _routed(spark, d).groupBy("node").agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("y"))


@query(f"WITH {AS_FLOAT} SELECT {NEXT} AS node, round(y, 2) AS y FROM lines WHERE w > 1")
def oob_route(spark, d):
    """Rows outside a sample take the same way."""
    return _routed(spark, d, 25.0).select("node", F.round("y", 2).alias("y"))


# Trees of depth two, grown by the engine; the SQL unrolls both levels.
ROOT = f"{BINS}, {hist('h', '0')}, {search('h', 's')}"
SIDE = "(SELECT CASE WHEN coalesce(c.bin <= s.bin, s.dl) THEN 1 ELSE 2 END FROM s, long x LEFT JOIN cut c ON c.fid = x.fid AND c.v = x.v WHERE x.fid = s.fid AND x.id = l.id)"


def level_two() -> str:
    return f"""side AS (SELECT x.id, CASE WHEN coalesce(c.bin <= s.bin, s.dl) THEN 1 ELSE 2 END AS side FROM s, long x LEFT JOIN cut c ON c.fid = x.fid AND c.v = x.v WHERE x.fid = s.fid),
    h2 AS (SELECT side AS node, l.fid, coalesce(c.bin, nb.n_bins - 1) AS bin, sum(g) AS sg, count(*)::DOUBLE AS sh, count(*) AS cnt FROM long l JOIN side USING (id) JOIN nb ON nb.fid = l.fid LEFT JOIN cut c ON c.fid = l.fid AND c.v = l.v GROUP BY ALL)"""


LEAVES2 = """leaf2 AS (SELECT side.side, CASE WHEN coalesce(c.bin <= s2.bin, s2.dl) THEN 1 ELSE 2 END AS kid, g FROM side JOIN s2 ON {on} JOIN long x ON x.id = side.id AND x.fid = s2.fid LEFT JOIN cut c ON c.fid = x.fid AND c.v = x.v)
    SELECT round(-sum(g) / (count(*) + 1), 4) AS value, count(*) AS cover FROM leaf2 GROUP BY side, kid"""


def _tree(spark, d, grower, **tree):
    c = Config()
    c.dispatch.grower_name, c.booster.n_iters = grower, 1
    for k, v in tree.items():
        setattr(c.tree, k, v)
    return booster.train(c, lines(spark, d), NAMES, "y").trees[0]


def _leaf_rows(spark, t):
    return spark.createDataFrame([(round(t.value[i], 4), int(t.cover[i])) for i in t.leaves], "value double, cover long")


@query(f"WITH {ROOT}, {level_two()}, {search('h2', 's2')}, {LEAVES2.format(on='s2.node = side.side')}")
def tree_depthwise(spark, d):
    return _leaf_rows(spark, _tree(spark, d, "depthwise", max_depth=2))


@query(f"WITH {BINS}, {hist('h', '0')}, {search('h', 's', rows=0)}, {level_two()}, {search('h2', 's2', rows=0, level=True)}, {LEAVES2.format(on='true')}")
def tree_levelwise(spark, d):
    return _leaf_rows(spark, _tree(spark, d, "levelwise", max_depth=2))


@query(f"""WITH {ROOT}, {level_two()}, {search('h2', 's2')}, top AS (SELECT * FROM s2 ORDER BY gain DESC, node LIMIT 1),
    three AS (SELECT CASE WHEN side.side <> top.node THEN 0 WHEN coalesce(c.bin <= top.bin, top.dl) THEN 1 ELSE 2 END AS leaf, g FROM side, top JOIN long x ON x.fid = top.fid LEFT JOIN cut c ON c.fid = x.fid AND c.v = x.v WHERE x.id = side.id)
    SELECT round(-sum(g) / (count(*) + 1), 4) AS value, count(*) AS cover FROM three GROUP BY leaf""")
def tree_leafwise(spark, d):
    return _leaf_rows(spark, _tree(spark, d, "leafwise", max_leaves=3))


@query(f"WITH {ROOT} SELECT unnest([1, 2]) AS node, unnest([CL_, tc - CL_])::BIGINT AS cover FROM s")
def node_covers(spark, d):
    t = _tree(spark, d, "depthwise", max_depth=1)
    return spark.createDataFrame([(n, int(t.cover[n])) for n in (1, 2)], "node int, cover long")


@query(f"""WITH {ROOT} SELECT 0 AS tree, unnest([0, 1, 2]) AS node, unnest([fid, -1, -1])::INT AS fid, unnest([1, -1, -1]) AS left, unnest([2, -1, -1]) AS right,
    unnest([0.0e0, round(-GL_ / (HL_ + 1), 3), round(-(tg - GL_) / (th - HL_ + 1), 3)]) AS value, unnest([round(gain / 1000, 1), 0.0e0, 0.0e0]) AS gain, unnest([tc, CL_, tc - CL_])::DOUBLE AS cover FROM s""")
def tree_table(spark, d):
    c = Config()
    c.booster.n_iters, c.tree.max_depth = 1, 1
    t = booster.train(c, lines(spark, d), NAMES, "y").tree_table(spark)
    return t.select("tree", "node", "fid", "left", "right", F.round("value", 3).alias("value"), F.round(F.col("gain") / 1000, 1).alias("gain"), "cover")


QUERIES, ORACLE = query.queries, query.sql
