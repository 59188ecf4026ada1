"""Hand cases, properties and refusals of the engine."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice import BinnedDataset, Classifier, Model, OrderedTargetEncoder, Params, Regressor, interop, load_config, train
from coppice.__main__ import main
from coppice.config import Config, default_config_toml, dump_config
from coppice.operators import binning as B
from coppice.operators import split as S
from coppice.plans.booster import Patience


def frame(spark, n=400, seed=0):
    r = np.random.default_rng(seed)
    x = r.random((n, 3))
    y = 4 * x[:, 0] - 2 * x[:, 1] + (x[:, 2] > 0.5) + 0.05 * r.standard_normal(n)
    rows = [(i, float(a) if i % 11 else None, float(b), float(c), float(t), int(t > 1.2), f"c{int(t > 0.7) + int(t > 1.8)}") for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z int, k string").cache()


@pytest.fixture(scope="module")
def df(spark):
    return frame(spark)


X = ["a", "b", "c"]
SMALL = {"booster.n_iters": 3, "booster.learning_rate": 0.3, "tree.max_depth": 3, "tree.min_data_in_leaf": 5}


def test_cut_rules():
    inf = np.float32(np.inf)
    assert B.cuts_of(np.array([1.0, 2.0], np.float32), np.array([3, 4]), 255).tolist() == [1.0, 2.0, np.float32(B.FLT_MAX), inf]
    assert B.cuts_of(np.zeros(0, np.float32), np.zeros(0, int), 255).tolist() == [np.float32(B.FLT_MAX), inf]
    v = np.arange(100, dtype=np.float32)
    assert B.cuts_of(v, np.ones(100, int), 12)[:3].tolist() == [10.0, 20.0, 30.0]
    heavy = B.cuts_of(v, np.where(np.arange(100) == 40, 500, 1), 12)
    assert 39.5 in heavy and 40.5 in heavy


@pytest.mark.parametrize("edges", [[], [1.0, 1.0], [2.0, 1.0], [float("nan")], [float("inf")]])
def test_bad_edges(edges):
    with pytest.raises(ValueError):
        B.edges_to_cuts(edges)


def test_order_keys_of_any_id(spark):
    from coppice.functions.ranking import order_key

    ids = [0, 1, -1, 7, 2**31, 2**32 - 1, 2**32, 2**40 + 3, 2**63 - 1, -(2**63), -5_000_000_000]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "i long")
    for seed in (0, 5, 2**31):
        got = {r["i"]: r["k"] for r in df.select("i", order_key("i", seed).alias("k")).collect()}
        assert got.pop(None) is None
        assert got == {i: (i % 2**32) * ((2654435761 + 2 * seed) % 2**32) % 2**32 for i in ids}


def test_bins_agree(spark, df):
    cuts = B.fit_cuts(df, X, Config().bin_mapper)
    one = B.bin_table(df, cuts, ["id"]).toPandas().sort_values("id")
    two = B.bin_arrays(df, cuts, ["id"]).toPandas().sort_values("id")
    assert np.array_equal(one[["b0", "b1", "b2"]].to_numpy(), np.stack(two["bins"]))
    assert (one["b0"].to_numpy()[::11] == len(cuts.cuts[0]) - 1).all()


def plain_split(cells, n_bins, t, allowed=None, lo=-np.inf, hi=np.inf, sign=(0, 0, 0)):
    """The best candidate, tried one by one in the order of ties."""
    score = lambda g, h: max(abs(g) - t.lambda_l1, 0) ** 2 / (h + t.lambda_l2) if h + t.lambda_l2 > 0 else 0.0
    weight = lambda g, h: min(hi, max(lo, -np.sign(g) * max(abs(g) - t.lambda_l1, 0) / (h + t.lambda_l2)))
    best = None
    for f, n in enumerate(n_bins):
        total, miss = cells[f].sum(0), cells[f, n - 1]
        if total[2] < 2 * t.min_data_in_leaf or (allowed is not None and not allowed[f]):
            continue
        for b in range(n - 2):
            for default_left in (True, False) if miss.any() else (True,):
                left = cells[f, : b + 1].sum(0) + (miss if default_left else 0)
                right = total - left
                if min(left[1], right[1]) < t.min_child_hess or min(left[2], right[2]) < 0.5:
                    continue
                if sign[f] * (weight(*right[:2]) - weight(*left[:2])) < 0:
                    continue
                gain = score(*left[:2]) + score(*right[:2]) - score(*total[:2])
                if gain > 0 and gain >= t.min_gain_to_split and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, b, default_left
    return best


def test_split_search_against_brute_force():
    rng = np.random.default_rng(1)
    for i in range(60):
        n_bins = np.array([8, 5, 3])
        cells = np.zeros((3, 8, 3))
        for _ in range(40):
            g = rng.integers(-3, 4)
            for f, n in enumerate(n_bins):
                cells[f, rng.choice([*range(n - 2), n - 1] if i % 2 else range(n - 2))] += (g, 1, 1)
        t = Config().tree
        t.min_data_in_leaf, t.lambda_l1, t.min_child_hess, t.min_gain_to_split = 5, float(i % 3), float(1 + i % 4), float(i % 2)
        bounds = (-0.2, 0.2) if i % 5 == 0 else (-np.inf, np.inf)
        sign, allowed = np.array([1, -1, 0]) * (i % 2), np.array([True, i % 3 > 0, True])
        want, got = plain_split(cells, n_bins, t, allowed, *bounds, sign), S.find(cells, n_bins, t, allowed, *bounds, sign)
        assert (got is None) == (want is None)
        if got:
            assert (got.fid, got.bin, got.default_left) == want[1:] and got.gain == pytest.approx(want[0])


@pytest.mark.parametrize("grower", ["depthwise", "levelwise", "leafwise"])
def test_search_on_executors_grows_the_same_trees(df, grower, monkeypatch):
    """Cells that outgrow the driver are summed and searched by tiles of features on the executors."""
    from coppice.plans import search

    p = SMALL | {"dispatch.grower_name": grower, "tree.max_leaves": 6}
    here = train(p, df, X, "y", row_id="id")
    monkeypatch.setattr(search.Search.__init__, "__defaults__", (0,))
    monkeypatch.setattr(search, "TILE_CELLS", 300)
    there = train(p, df, X, "y", row_id="id")
    for a, b in zip(here.trees, there.trees):
        assert (a.fid, a.bin, a.default_left, a.cover) == (b.fid, b.bin, b.default_left, b.cover)
        assert np.allclose(a.value, b.value)


def test_greedy_cuts_against_a_scan():
    """The rule, a value at a time."""

    def scan(values, counts, budget):
        n = counts.sum()
        heavy = counts * (budget + 1) >= n
        rest, groups = int(counts[~heavy].sum()), max(1, budget + 1 - int(heavy.sum()))
        size, held, cuts = rest / groups, 0, []
        for i in range(len(values) - 1):
            held += counts[i]
            rest -= 0 if heavy[i] else counts[i]
            if not (heavy[i] or held >= size or (heavy[i + 1] and held >= max(1.0, size / 2))):
                continue
            cut = np.float32((float(values[i]) + float(values[i + 1])) / 2)
            if not cuts or cut > cuts[-1]:
                cuts.append(cut)
            if len(cuts) >= budget:
                break
            held = 0
            if not heavy[i] and groups > 1:
                groups -= 1
                size = rest / groups
        return cuts

    rng = np.random.default_rng(2)
    for i in range(200):
        n = int(rng.integers(5, 80))
        values, counts = np.sort(rng.choice(1000, n, replace=False)).astype(np.float32), rng.integers(1, 6, n)
        counts[rng.integers(0, n, int(rng.integers(1, 4)))] += int(rng.integers(10, 400))
        budget = int(rng.integers(2, 20))
        assert B.greedy_cuts(values, counts, budget).tolist() == scan(values, counts, budget), i


def test_selection_against_sorting(spark):
    from coppice.functions import ranking as R

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(500), np.full(300, 0.25), [-0.0, 0.0, 1e300, -1e300, 5e-324]])
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g long, x double").repartition(3)
    emit = lambda b: (b.column("g").to_numpy(), R.sortable(b.column("x").to_numpy()))
    for few in (50_000, 0):
        R.FEW_KEYS, kept = few, R.FEW_KEYS
        try:
            key, below, equal = R.select(df, emit, lambda n: n // 2, 4)
        finally:
            R.FEW_KEYS = kept
        for k in range(3):
            own = np.sort(x[g == k])
            v = own[len(own) // 2]
            assert R.unsorted(key)[k] == v and below[k] == (own < v).sum() and equal[k] == (own == v).sum()
        assert equal[3] == 0


def test_four_rows_split_and_three_do_not():
    cells = np.zeros((1, 6, 3))
    cells[0, :4] = [[-1, 1, 1], [-1, 1, 1], [1, 1, 1], [1, 1, 1]]
    t = Config().tree
    t.min_data_in_leaf = 1
    s = S.find(cells, np.array([6]), t)
    assert (s.bin, s.left[2], s.right[2], s.default_left) == (1, 2, 2, True)
    cells[0, :4, 0] = 1
    assert S.find(cells, np.array([6]), t) is None


@pytest.mark.parametrize("grower", ["depthwise", "levelwise", "leafwise", "cuda_leafwise"])
@pytest.mark.parametrize("sampler", ["all_rows", "bernoulli", "goss"])
def test_loss_falls(df, grower, sampler):
    m = train(SMALL | {"dispatch.grower_name": grower, "dispatch.sampler_name": sampler, "sampler.subsample": 0.8}, df, X, "y", row_id="id")
    a, b = m.raw(df).agg(F.avg((F.col("raw") - F.col("y")) ** 2), F.var_pop("y")).first()
    assert a < 0.6 * b and m.n_iters == 3


@pytest.mark.parametrize("objective", ["mae", "huber", "quantile", "poisson", "logloss"])
def test_objectives(df, objective):
    label = "z" if objective in ("logloss", "poisson") else "y"
    m = train(SMALL | {"dispatch.objective_name": objective}, df, X, label, row_id="id")
    rows = m.raw(df).select("raw", label).toPandas()
    y = rows[label].to_numpy(float)
    assert m.objective.loss(rows["raw"].to_numpy(), y).mean() < m.objective.loss(np.full(len(y), m.init[0]), y).mean()


def test_monotone_curve(spark, df):
    m = train(SMALL | {"tree.monotone_constraints": [0, 1, 0], "booster.n_iters": 4}, df, X, "y", row_id="id")
    grid = spark.createDataFrame([(0.5, i / 50, 0.4) for i in range(50)], "a double, b double, c double")
    v = [r["raw"] for r in m.raw(grid).orderBy("b").collect()]
    assert all(p <= q + 1e-9 for p, q in zip(v, v[1:]))


def test_interaction_paths(df):
    m = train(SMALL | {"tree.interaction_constraints": ["0+1", "2"]}, df, X, "y", row_id="id")
    for t in m.trees:
        for _, path in t.paths():
            used = {t.fid[n] for n, _ in path}
            assert used <= {0, 1} or used <= {2}


def test_leafwise_budget_and_depthwise_agree(df):
    p = SMALL | {"booster.n_iters": 1, "tree.max_depth": 2, "tree.max_leaves": 0}
    a = train(p | {"dispatch.grower_name": "leafwise"}, df, X, "y", row_id="id").trees[0]
    b = train(p, df, X, "y", row_id="id").trees[0]
    leaves = lambda t: sorted((round(t.value[i], 9), t.cover[i]) for i in t.leaves)
    assert leaves(a) == leaves(b)
    c = train(p | {"dispatch.grower_name": "leafwise", "tree.max_leaves": 3}, df, X, "y", row_id="id").trees[0]
    assert len(c.leaves) == 3


def plain_expectation(t, x, known, node=0):
    """The tree's mean over the rows that agree with ``x`` on the features in ``known``, by cover."""
    if t.fid[node] < 0:
        return t.value[node]
    f, kids = t.fid[node], (t.left[node], t.right[node])
    if f in known:
        left = t.default_left[node] if np.isnan(x[f]) else x[f] <= np.float32(t.threshold[node])
        return plain_expectation(t, x, known, kids[0] if left else kids[1])
    total = sum(t.cover[k] for k in kids)
    return sum(t.cover[k] / total * plain_expectation(t, x, known, k) for k in kids if t.cover[k])


def test_shap_sums_and_brute_force(df):
    """Shapley values from all subsets of features."""
    from itertools import combinations
    from math import factorial

    m = train(SMALL, df, X, "y", row_id="id")
    got = m.raw(m.contributions(df)).orderBy("id").limit(12).toPandas()
    assert np.allclose(got["contributions"].map(sum), got["raw"], atol=1e-9)
    for _, r in got.iterrows():
        x = np.array([r[c] for c in X], np.float32)
        for i in range(3):
            others, phi = [j for j in range(3) if j != i], 0.0
            for k in range(3):
                for some in combinations(others, k):
                    w = factorial(k) * factorial(2 - k) / factorial(3)
                    phi += w * sum(plain_expectation(t, x, {*some, i}) - plain_expectation(t, x, set(some)) for t in m.trees)
            assert r["contributions"][i] == pytest.approx(m.rate * phi, abs=1e-9)


def test_binned_twins_equal_values(df):
    m = train(SMALL | {"booster.n_iters": 12, "tree.max_depth": 4, "dispatch.objective_name": "logloss"}, BinnedDataset(df, X, "z", row_id="id"))
    bins = B.bin_arrays(df, m.cuts, ["id"])
    for name in ("raw", "predict", "predict_proba", "predict_leaf", "contributions"):
        a, b = (getattr(m, name)(t, "out", binned=binned).orderBy("id").toPandas()["out"].tolist() for t, binned in ((df, False), (bins, True)))
        assert np.allclose(np.array(a, float), np.array(b, float), atol=1e-12), name
    a, b = (m.predict_staged(t, "id", binned=binned).orderBy("id", "iteration").toPandas()["raw"] for t, binned in ((df, False), (bins, True)))
    assert np.allclose(a, b) and len(a) == 12 * df.count()
    last = m.raw(df).orderBy("id").toPandas()["raw"]
    assert np.allclose(a[11::12], last)


def test_columns_of_any_name(df):
    m = train(SMALL, df, X, "y", row_id="id")
    big = train(SMALL | {"booster.n_iters": 20}, df, X, "y", row_id="id")
    odd = df.withColumns({c: F.lit(7) for c in ("_raw", "_x0", "raw", "features", "_c", "_p", "code", "stages", "Prediction_")})
    for model in (m, big):
        got = model.contributions(model.predict_leaf(model.predict(odd)))
        assert got.columns == [*odd.columns, "prediction", "leaf", "contributions"] and got.where("_raw = 7 and _x0 = 7 and raw = 7").count() == df.count()
    c = Classifier(n_iters=2).fit(odd, X, "k")
    assert c.predict(c.predict_proba(odd)).where("code = 7 and _c = 7").count() == df.count() and c.score(odd, "k") > 0.5


def test_small_ids_and_strings_sample_alike(spark, df):
    """Ids of any kind draw about the share that is asked for."""
    from coppice.operators.samplers import bernoulli

    for ids in (np.arange(-1000, 0), np.arange(2**62, 2**62 + 1000), np.arange(1000)):
        assert abs(bernoulli(ids, 0.3, 1).mean() - 0.3) < 0.05
    named = df.withColumn("id", F.concat(F.lit("row "), "id"))
    assert train(SMALL | {"dispatch.sampler_name": "bernoulli", "sampler.subsample": 0.5}, named, X, "y", row_id="id").trees[0].cover[0] == pytest.approx(200, abs=40)
    few = B.sample_rows(df.withColumn("id", F.col("id") * (1 << 32)), 50, "id")  # keys that are all alike
    assert few.count() == 50


def test_early_stopping_and_history(df):
    m = train(SMALL | {"booster.early_stopping_rounds": 1, "booster.n_iters": 6, "booster.learning_rate": 1.0}, df.where("id % 4 > 0"), X, "y", row_id="id", eval_set=df.where("id % 4 = 0"))
    assert m.n_iters == int(np.argmin(m.eval_history)) + 1
    p = Patience(2)
    assert [p.stop(x) for x in (3, 2, 2, 2)] == [False, False, False, True] and p.at == 1


def test_refusals(df):
    for bad in ({"dispatch.objective_name": "x"}, {"dispatch.grower_name": "levelwise", "tree.monotone_constraints": [1, 0, 0]}, {"booster.early_stopping_rounds": 3}, {"tree.monotone_constraints": [1, 1, 1, 1]}):
        with pytest.raises(ValueError):
            train(SMALL | bad, df, X, "y")
    with pytest.raises(ValueError):
        train(SMALL, df.limit(0), X, "y")
    with pytest.raises(ValueError):
        train(SMALL | {"booster.dart_drop_rate": 0.5}, df, X, "y", eval_set=df)
    with pytest.raises(ValueError):
        load_config("[tree]\nnothing = 1")


def test_config_round_trip():
    assert load_config(default_config_toml()) == Config()
    c = load_config("[tree]\nmax_depth = 3", ["tree.max_depth=4", "tree.monotone_constraints=1,-1"])
    assert c.tree.max_depth == 4 and c.tree.monotone_constraints == [1, -1] and load_config(dump_config(c)) == c
    assert (Params({"tree.max_depth": 2}) | {"tree.max_depth": 5}).to_dict() == {"tree.max_depth": 5}


def test_interop():
    assert interop.from_lightgbm({"num_leaves": 63, "max_depth": -1}).to_dict() == {"tree.max_leaves": 63, "tree.max_depth": 255}
    assert interop.from_catboost({"border_count": 254, "grow_policy": "SymmetricTree"}).to_dict() == {"bin_mapper.max_bin": 255, "dispatch.grower_name": "levelwise"}
    assert interop.from_xgboost({"subsample": 0.5, "tree_method": "hist"}).to_dict() == {"dispatch.sampler_name": "bernoulli", "sampler.subsample": 0.5}
    assert interop.to_xgboost({"dispatch.objective_name": "softmax", "dispatch.grower_name": "cuda_leafwise"}) == {"objective": "multi:softprob", "grow_policy": "lossguide"}
    with pytest.raises(ValueError):
        interop.from_xgboost({"colsample_bynode": 0.5})
    assert interop.to_lightgbm({"objective.huber_delta": 1.0}, strict=False) == {}


def test_estimators(tmp_path, df):
    r = Regressor(n_iters=3, learning_rate=0.3, max_depth=3).fit(df, X, "y", row_id="id")
    assert r.score(df, "y") > 0.3 and abs(sum(r.feature_importances_) - 1) < 1e-9
    r.engine.save(str(tmp_path / "engine"))
    assert Regressor.from_file(str(tmp_path / "engine")).dump() == r.dump()
    c = Classifier(n_iters=3, learning_rate=0.3, max_depth=3).fit(df, X, "k", row_id="id")
    assert c.classes_ == ["c0", "c1", "c2"] and c.score(df, "k") > 0.5
    assert abs(sum(c.predict_proba(df).first()["probability"]) - 1) < 1e-9
    for bad in ("bad", "none"):
        with pytest.raises(ValueError):
            (tmp_path / "bad").mkdir(exist_ok=True)
            (tmp_path / "bad" / "model.json").write_text("{}")
            Model.load(str(tmp_path / bad))


def test_estimators_are_stages(tmp_path, df):
    """Pipelines, cross-validation, parameter maps and persistence."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    r = Regressor(n_iters=2, learning_rate=0.3, max_depth=2, inputCols=X, labelCol="y", row_id="id", params={"tree.min_data_in_leaf": 5})
    fitted = Pipeline(stages=[r]).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    a, b = (m.transform(df).orderBy("id").toPandas()["prediction"] for m in (fitted, again))
    assert np.allclose(a, b) and again.stages[0].getOrDefault("n_iters") == 2
    grid = ParamGridBuilder().addGrid(r.n_iters, [1, 4]).build()
    best = CrossValidator(estimator=r, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y"), numFolds=2).fit(df).bestModel
    assert best.n_iters_ == 4
    r.save(str(tmp_path / "e"))
    assert Regressor.load(str(tmp_path / "e")).get_params() == r.get_params()
    c = Classifier(n_iters=2, inputCols=X, labelCol="k").fit(df)
    c.save(str(tmp_path / "c"))
    assert type(c).load(str(tmp_path / "c")).classes_ == c.classes_ and "probability" in c.transform(df).columns
    enc = OrderedTargetEncoder(["c"], labelCol="y", keep_codes=False)
    both = Pipeline(stages=[enc, Regressor(n_iters=1, inputCols=["a", "b", "c_te"], labelCol="y")]).fit(df)
    assert "prediction" in both.transform(df).columns


def test_estimator_contracts(df):
    r = Regressor(n_iters=6, learning_rate=1.0, early_stopping_rounds=1).fit(df.where("id % 4 > 0"), X, "y", eval_set=df.where("id % 4 = 0"), row_id="id")
    losses = r.evals_result()["valid"]["mse"]
    assert r.best_iteration == int(np.argmin(losses)) and r.best_score == min(losses) and r.n_iters_ == r.best_iteration + 1
    plain = Regressor(n_iters=1).fit(df, X, "y")
    assert plain.evals_result() == {}
    for name in ("best_iteration", "best_score"):
        with pytest.raises(AttributeError):
            getattr(plain, name)
    with pytest.raises(ValueError, match="missing"):
        plain.predict(df.drop("a"))
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        Regressor(n_iters=1).fit(df, X[::-1], "y", init_model=plain)
    with pytest.raises(ValueError):
        Regressor(n_iters=1).set_params(nothing=1)


def test_constraints_by_name_and_refusals_of_datasets(df):
    a = train(SMALL | {"tree.monotone_constraints": {"b": -1}}, df, X, "y", row_id="id")
    b = train(SMALL | {"tree.monotone_constraints": [0, -1, 0]}, df, X, "y", row_id="id")
    assert a.dump() == b.dump() and a.config.tree.monotone_constraints == [0, -1, 0]
    for bad in ({"nothing": 1}, {"a": 2}, {"a": True}):
        with pytest.raises(ValueError):
            train(SMALL | {"tree.monotone_constraints": bad}, df, X, "y")
    ds = BinnedDataset(df, X, "y", max_bin=32)
    with pytest.raises(ValueError, match="max_bin"):
        train(SMALL | {"bin_mapper.max_bin": 64}, ds)
    assert train(SMALL | {"bin_mapper.max_bin": 32}, ds).n_iters == 3
    for bad in ({"max_bin": 16}, {"n_samples": 5}, {"seed": 3}, {"bin_edges": {0: [1.0]}}):
        with pytest.raises(ValueError):
            BinnedDataset(df, X, "y", reference=ds, **bad)
    with pytest.raises(ValueError):
        BinnedDataset(df, ["a", "zz"], "y")


def test_datasets_by_name(spark, sf):
    from coppice.sources.registry import dataset, of_tier

    for tier in ("scale", "quality"):
        for d in of_tier(tier):
            assert {*d.features, d.label} <= set(d.load(spark, sf).columns)
    with pytest.raises(ValueError):
        dataset("none")


def test_encoder_is_causal(spark, df):
    src = df.select("id", F.when(F.col("id") % 13 > 0, F.col("id") % 5).cast("double").alias("g"), "z")
    enc = OrderedTargetEncoder(["g"], keep_codes=False)
    a = {r["id"]: r["g_te"] for r in enc.fit_transform(src, "z", "id").collect()}
    flipped = src.withColumn("z", F.when(F.col("id") == 7, 1 - F.col("z")).otherwise(F.col("z")))
    enc2 = OrderedTargetEncoder(["g"], keep_codes=False)
    b = {r["id"]: r["g_te"] for r in enc2.fit_transform(flipped, "z", "id").collect()}
    assert abs(b[7] - a[7]) < 0.01  # its own label only moves the prior
    new = spark.createDataFrame([(1, 99.0)], "id int, g double")
    assert enc.transform(new).first()["g_te"] == pytest.approx(enc.prior)


def test_text_sources(spark, tmp_path):
    from coppice.config import Data
    from coppice.sources.text import read_csv, read_libsvm

    (tmp_path / "a.csv").write_text("label,f1,f2\n1, nan ,2\n\n0,3,4.5\n")
    rows = sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv")).collect())
    assert rows[0] == (0.0, 3.0, 4.5) and np.isnan(rows[1][1])
    (tmp_path / "b.csv").write_text("1,,2\n")
    with pytest.raises(Exception, match="malformed"):
        read_csv(spark, str(tmp_path / "b.csv"), Data(header=False)).collect()
    (tmp_path / "d.csv").write_text("\n1,2,3\n4,5,6\n1,2,3\n \n7,\t8,9\n")  # rows like the header are rows
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "d.csv")).collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0), (7.0, 8.0, 9.0)]
    with pytest.raises(Exception, match="malformed"):
        (tmp_path / "e.csv").write_text('a,b\n"1",2\n')
        read_csv(spark, str(tmp_path / "e.csv")).collect()
    (tmp_path / "c").write_text("# note\n1 2:0.5\n+1 1:2 3:4\n")
    got = sorted(tuple(r) for r in read_libsvm(spark, str(tmp_path / "c"), 4).collect())
    assert got == [(0.0, 2.0, 0.0, 4.0, 0.0), (1.0, 0.0, 0.5, 0.0, 0.0)]


def test_command_line(spark, tmp_path):
    lines = "\n".join(f"{i % 7},{i % 7 + 0.5},{i % 3}" for i in range(200))
    (tmp_path / "t.csv").write_text("label,f1,f2\n" + lines + "\n")
    model, out = str(tmp_path / "m"), io.StringIO()
    sets = ["--set", f"data.train={tmp_path}/t.csv", "--set", "booster.n_iters=2", "--set", "tree.max_depth=2"]
    assert main(["fit", *sets, "--model", model], out) == 0 and "rmse" in out.getvalue()
    assert main(["predict", "--model", model, "--data", f"{tmp_path}/t.csv", "--out", f"{tmp_path}/p"], out) == 0
    assert main(["eval", "--model", model, "--data", f"{tmp_path}/t.csv", "--set", "metrics.names=r2"], out) == 0
    for command in (["dump", "--model", model], ["importance", "--model", model], ["info"], ["params"]):
        assert main(command, out) == 0
    assert "tree 0:" in out.getvalue() and "[tree]" in out.getvalue()


def test_stream_scores(spark, tmp_path, df):
    from coppice.streaming import write_scores

    m = train(SMALL, df, X, "y", row_id="id")
    df.select("id", *X).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.select("id", *X).schema).parquet(str(tmp_path / "in"))
    write_scores(m, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()
