"""Exact quantiles, positions, ranks, fronts and samples by ranges, against the direct ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiospark.operators import features, summary
from ratiospark.operators.positions import exact_sample, with_average_rank, with_position
from ratiospark.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for k in range(3000):
        group = ["big", "big", "big", "ties", "wide", None][k % 6]
        v = {"big": rng.normal(1, 0.05), "ties": float(rng.integers(-2, 3)), "wide": float(np.sign(rng.normal()) * 10 ** rng.uniform(-9, 9)), None: rng.normal()}[group]
        out.append((k, group, v if k % 50 else (None if k % 100 else float("nan")), float(rng.integers(0, 40))))
    out += [(10_000, "one", 5.0, 1.0), (10_001, "none", None, 1.0)]
    return spark.createDataFrame(out, "k long, g string, v double, w double").cache()


WANTED = {"med": ("v", 0.5), "low": ("v", 0.05), "high": ("v", 0.975), "least": ("v", 0.0), "most": ("v", 1.0), "other": ("w", 0.3)}


@pytest.mark.parametrize("limit", [0, 3, 100])
@pytest.mark.parametrize("groups", [["g"], []])
def test_quantiles_by_intervals(rows, groups, limit):
    wanted = {k: (F.col(c), q) for k, (c, q) in WANTED.items()}
    others = {"n": F.count("*"), "mean_w": F.avg("w")}
    got = {r["g"] if groups else 0: r for r in quantiles(rows, groups, wanted, others, in_memory=max(limit, 1)).collect()}
    want = {r["g"] if groups else 0: r for r in quantiles(rows, groups, wanted, others).collect()}
    assert set(got) == set(want)
    for g, r in want.items():
        assert got[g].n == r.n and got[g].mean_w == pytest.approx(r.mean_w)
        for k in WANTED:
            assert got[g][k] == (None if r[k] is None else pytest.approx(r[k], rel=1e-12)), (g, k)


@pytest.mark.parametrize("groups", [["g"], []])
def test_positions_by_ranges(rows, groups):
    many = rows.repartition(7)
    got = {r.k: r.pos for r in with_position(many, ["w", "k"], groups, in_memory=1).collect()}
    seen = {}
    for r in sorted(rows.collect(), key=lambda r: (str(r.g) if groups else "", r.w, r.k)):
        at = r.g if groups else 0
        seen[at] = seen.get(at, 0) + 1
        assert got[r.k] == seen[at]


def test_average_ranks(rows):
    got = {r.k: r.u for r in with_average_rank(rows, "w", "u").collect()}
    w = sorted(r.w for r in rows.collect())
    for r in rows.collect():
        places = [i + 1 for i, x in enumerate(w) if x == r.w]
        assert got[r.k] == pytest.approx(np.mean(places) / len(w))


def test_front_of_many_gains(spark):
    rng = np.random.default_rng(1)
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    points += [(1000 + k, a, b) for k, a, b in points[:20]]
    df = spark.createDataFrame(points, "k long, gain double, loss double").repartition(6)
    got = {r.k for r in summary.pareto_front(df, "gain", "loss").collect()}
    want = {k for k, a, b in points if not any(c >= a and d <= b and (c > a or d < b) for _, c, d in points)}
    assert got == want


@pytest.mark.parametrize("fraction", [0.001, 0.1, 0.5, 1.0])
def test_sample_has_its_size(rows, fraction):
    got = [r.k for r in exact_sample(rows, fraction, ["k"], 7).collect()]
    assert len(got) == len(set(got)) == int(fraction * rows.count())
    assert sorted(got) == sorted(r.k for r in exact_sample(rows.repartition(5), fraction, ["k"], 7).collect())


def test_clusters_keep_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 5.0, 7.0), (4, 1.1, 2.1)], "k long, a double, b double")
    found = {r.k: r.cluster for r in features.cluster_labels(df, df, ["a", "b"], 2)[0].collect()}
    assert set(found) == {1, 2, 3, 4} and found[2] is None and found[1] == found[4] != found[3]


def test_a_scope_leaves_no_staged_table(spark, tmp_path, rows):
    from pathlib import Path

    from ratiospark.operators import ratio_study
    from ratiospark.sources.staging import staging

    base = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    sales = rows.select("g", "k", (F.abs("v") + 1).alias("sp"), (F.abs("w") + 1).alias("av"))
    before = set(base.iterdir())
    with staging(spark):
        ratio_study.bundle(sales, ["g"], keys=["k"]).write.parquet(str(tmp_path / "out"))
        assert set(base.iterdir()) > before
    assert set(base.iterdir()) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() > 1
