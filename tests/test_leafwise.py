"""Leaf-wise boosting: splits against brute force, trees against one split at a time, and models written and read."""

import itertools
from dataclasses import replace

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from ratiospark.operators import boosting, leafwise
from ratiospark.operators.leafwise import BINS, TreePlan, best_split
from ratiospark.plans import catalogue

EXACT = TreePlan(least=1, l1=0.0, l2=0.5, cat_smooth=0.5, cat_l2=0.0, cat_least=1, cat_set=BINS)


def sums_of(bins, g, h, features):
    out = np.zeros((features, BINS, 3))
    for k in range(features):
        for j, x in enumerate((g, h, np.ones(len(g)))):
            out[k, :, j] = np.bincount(bins[:, k], x, BINS)
    return out


def gain_of(g, h, left, plan=EXACT):
    def score(a):
        return max(abs(g[a].sum()) - plan.l1, 0) ** 2 / (h[a].sum() + plan.l2)

    return score(left) + score(~left) - score(np.ones(len(g), dtype=bool))


def test_category_split_is_the_best_of_all_subsets():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, k = 200, int(rng.integers(2, 9))
        bins = rng.integers(0, k, (n, 1))
        g, h = rng.normal(size=n) + rng.normal(size=k)[bins[:, 0]], rng.uniform(0.5, 2, n)
        best = max(gain_of(g, h, np.isin(bins[:, 0], s)) for m in range(1, k) for s in itertools.combinations(range(k), m))
        # Without a penalty on hessians the order by gradient over hessian holds the best set.
        plan = TreePlan(least=1, l1=0.0, l2=0.0, cat_smooth=0.0, cat_l2=0.0, cat_least=1, cat_set=BINS)
        free = max(gain_of(g, h, np.isin(bins[:, 0], s), plan) for m in range(1, k) for s in itertools.combinations(range(k), m))
        found = best_split(sums_of(bins, g, h, 1), [True], plan)
        assert np.isclose(found.gain, free)
        assert np.isclose(gain_of(g, h, np.isin(bins[:, 0], found.left), plan), found.gain)
        assert best_split(sums_of(bins, g, h, 1), [True], EXACT).gain <= best + 1e-9


def test_number_split_is_the_best_cut_with_missing_values_on_either_side():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = 150
        bins = rng.integers(0, 12, (n, 2))
        g, h = rng.normal(size=n) + (bins[:, 0] == 0) * 2 + (bins[:, 1] > 6), rng.uniform(0.5, 2, n)
        every = []
        for f in (0, 1):
            for cut in range(1, 12):
                for missing in ((), (0,)):
                    left = np.isin(bins[:, f], [*missing, *range(1, cut + 1)])
                    if left.any() and not left.all():
                        every.append(gain_of(g, h, left))
        found = best_split(sums_of(bins, g, h, 2), [False, False], EXACT)
        assert np.isclose(found.gain, max(every))
        assert np.isclose(gain_of(g, h, np.isin(bins[:, found.feature], found.left)), found.gain)


def test_small_leaves_and_small_gains_are_no_splits():
    g, h = np.array([-5.0, 1, 1, 1, 1, 1]), np.ones(6)
    sums = sums_of(np.arange(1, 7)[:, None], g, h, 1)
    assert best_split(sums, [False], TreePlan(least=1)).left == (1,)
    assert best_split(sums, [False], TreePlan(least=2)).left == (1, 2)
    assert best_split(sums, [False], TreePlan(least=4)) is None
    assert best_split(sums, [False], TreePlan(least=1, min_gain=1e6)) is None


def one_at_a_time(bins, g, h, categorical, plan):
    """Best-first growth that recounts every leaf: (leaf values by row)."""
    leaves, out = [(np.arange(len(g)), 0, 0.0)], []
    while len(leaves) < plan.leaves:
        splits = [(best_split(sums_of(bins[at], g[at], h[at], bins.shape[1]), categorical, plan) if depth < plan.depth else None) for at, depth, _ in leaves]
        if not any(splits):
            break
        k = max((k for k, s in enumerate(splits) if s), key=lambda k: splits[k].gain)
        at, depth, _ = leaves.pop(k)
        left = np.isin(bins[at, splits[k].feature], splits[k].left)
        more = plan.cat_l2 if categorical[splits[k].feature] else 0.0
        leaves += [(at[left], depth + 1, more), (at[~left], depth + 1, more)]
    out = np.zeros(len(g))
    for at, _, more in leaves:
        out[at] = leafwise._leaf(g[at].sum(), h[at].sum(), plan.l1, plan.l2 + more)
    return out


@pytest.mark.parametrize("plan", [TreePlan(leaves=12, least=5, cat_least=5), TreePlan(leaves=31, depth=4, least=3, cat_least=1), TreePlan(leaves=2)])
def test_tree_equals_one_split_at_a_time(spark, plan):
    rng = np.random.default_rng(5)
    n = 900
    bins = np.c_[rng.integers(0, 30, n), rng.integers(0, 6, n), rng.integers(0, 4, n)].astype(np.uint8)
    g = np.sin(bins[:, 0]) + (bins[:, 1] == 2) * 1.5 - (bins[:, 2] == 1) * (bins[:, 0] > 11) + rng.normal(0, 0.3, n)
    h = np.full(n, 2.0)
    categorical = [False, True, False]
    rows = spark.createDataFrame([(bytearray(b.tobytes()), float(x), float(y)) for b, x, y in zip(bins, g, h, strict=True)], "bins binary, g double, h double").repartition(3)
    tree = leafwise.grow(rows, categorical, plan, 3)
    assert tree.feature.count(-1) <= plan.leaves
    assert np.allclose(np.array(tree.value)[tree.nodes_of(bins)], one_at_a_time(bins, g, h, categorical, plan))


@pytest.fixture(scope="module")
def houses(spark):
    rng = np.random.default_rng(6)
    n = 1500
    kind, x = rng.integers(0, 9, n), rng.normal(size=n)
    y = 12 + np.where(kind % 2 == 1, 0.8, -0.8) + np.maximum(x, 0) + rng.normal(0, 0.1, n)
    rows = [(int(k), None if k == 8 else "abcdefghi"[k], None if i % 11 == 0 else float(v), float(t)) for i, (k, v, t) in enumerate(zip(kind, x, y, strict=True))]
    return spark.createDataFrame(rows, "code long, kind string, x double, y double").repartition(4)


def error(df):
    return df.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]


def test_categories_are_split_as_sets_and_models_survive_a_file(spark, houses, tmp_path):
    seen = []
    plan = TreePlan(rounds=8, leaves=6, rate=0.4, least=10, cat_least=10)
    model = leafwise.boost_leafwise(houses, ["kind", "x"], "y", boosting.squared_error(), plan, categorical=["kind"], hook=lambda k, rows: seen.append(rows.agg(F.avg(F.pow(F.col("f") - F.col("y"), 2))).first()[0]))
    assert seen == sorted(seen, reverse=True)
    scored = model.transform(houses)
    assert np.isclose(error(scored), seen[-1])
    assert error(scored) < 0.1
    # The two kinds of kinds are told apart by one split; depth-wise trees on the code need several.
    first = model.trees[0]
    assert first.feature[0] == 0 and model.importance()["kind"] >= 1
    model.save(spark, str(tmp_path / "model"))
    again = leafwise.LeafwiseBooster.load(spark, str(tmp_path / "model"))
    assert again == model
    unseen = spark.createDataFrame([("zzz", None), (None, float("nan")), ("a", 1e9)], "kind string, x double")
    assert again.transform(unseen).where("prediction IS NULL OR isnan(prediction)").count() == 0


def test_leafwise_is_no_worse_than_depthwise(houses):
    numbers = houses.withColumn("code", F.col("code").cast("double"))
    deep = boosting.boost(numbers, ["code", "x"], "y", boosting.squared_error(), rounds=6, depth=3, rate=0.3, least=10)
    wide = leafwise.boost_leafwise(numbers, ["code", "x"], "y", boosting.squared_error(), TreePlan(rounds=6, leaves=8, rate=0.3, least=10))
    assert error(wide.transform(numbers)) <= error(deep.transform(numbers)) + 1e-6


def test_objectives_by_bin_and_with_weights(houses):
    plan = TreePlan(rounds=3, leaves=4, rate=0.3, least=10)
    for objective in (boosting.bin_mean_penalty(1.0), boosting.primal_dual(1.0, 0.5)):
        model = leafwise.boost_leafwise(houses, ["x"], "y", objective, plan, target_bins=4)
        assert len(model.trees) == 3 and error(model.transform(houses)) < houses.agg(F.var_pop("y")).first()[0]


def test_rows_are_not_written_in_every_round(spark, houses, monkeypatch):
    written, before = [], spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(leafwise, "staged", lambda df, stage=leafwise.staged: written.append(df.columns) or stage(df))
    plan = TreePlan(rounds=7, leaves=4, rate=0.3, least=10, cat_least=10)
    fit = lambda objective, **more: leafwise.boost_leafwise(houses, ["kind", "x"], "y", objective, plan, categorical=["kind"], **more)
    model = fit(boosting.squared_error())
    # The picked rows, the binned rows, and scores once after five rounds; gradients never.
    assert len(written) == 3 and not any("g" in c or "steps" in c for c in written)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert model == fit(boosting.squared_error(), stage_every=1)
    # An objective that carries weights has its rows written in every round.
    written.clear()
    fit(boosting.primal_dual(1.0, 0.5))
    assert sum("weight" in c for c in written) >= 7


def test_rows_go_only_where_a_wanted_leaf_is():
    tree = leafwise.Grown([0, 1, -1, -1, -1], [1, 3, -1, -1, -1], [2, 4, -1, -1, -1], [(1, 2), (1,), (), (), ()], [0.0] * 5)
    bins = np.array([[1, 1], [2, 3], [5, 1], [9, 9]], dtype=np.uint8)
    assert tree.nodes_of(bins).tolist() == [3, 4, 2, 2]
    for leaf in (2, 3, 4):
        assert (tree.router([leaf])(bins) == leaf).tolist() == (tree.nodes_of(bins) == leaf).tolist()


def test_query_grows_all_trees_of_the_plan(spark, monkeypatch):
    """the query's plan is the whole one, 200 rounds of 31 leaves."""
    plans, fit = [], leafwise.boost_leafwise
    monkeypatch.setattr(leafwise, "boost_leafwise", lambda df, features, y, objective, plan, **more: plans.append(plan) or fit(df, features, y, objective, replace(plan, rounds=1), **more))
    assert catalogue.gbm_leafwise(spark, SF).count() == 3
    assert plans == [TreePlan()] and (plans[0].rounds, plans[0].leaves, plans[0].depth, plans[0].bins, plans[0].share) == (200, 31, 15, 255, 1.0)


def test_scores_kept_from_round_to_round_give_the_same_trees(spark, houses, monkeypatch):
    """F1: 200 rounds neither write scores 40 times nor hang on all rounds before; the trees are those of rows made anew in each round."""
    written, before = [], spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(leafwise, "staged", lambda df, stage=leafwise.staged: written.append(df.columns) or stage(df))
    monkeypatch.setattr(leafwise, "CHAIN", 3)
    fit = lambda objective, **more: leafwise.boost_leafwise(houses, ["kind", "x"], "y", objective, TreePlan(rounds=8, leaves=5, rate=0.3, least=10, cat_least=10), categorical=["kind"], **more)
    model = fit(boosting.squared_error(), stage_every=2)
    assert len(model.trees) == 8 and len(written) == 2 + 3  # after 2, 4 and 8 rounds
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert model == fit(boosting.squared_error(), stage_every=100)
    # Without a step of its own, an objective's columns are computed by Spark.
    other = fit(lambda df: boosting.squared_error()(df))
    assert [t.left for t in other.trees] == [t.left for t in model.trees] and all(np.allclose(a.value, b.value) for a, b in zip(model.trees, other.trees, strict=True))
