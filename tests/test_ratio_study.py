import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiospark.operators import flags, ratio_study
from ratiospark.operators.positions import with_position


def frame(spark, av, sp):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(av, sp, strict=True))], "k long, av double, sp double")


def numpy_study(av, sp):
    r, n = av / sp, len(sp)
    m = np.median(r)
    x, y = np.log2(0.5 * (av / m + sp)), (r - m) / m
    proxy = 0.5 * sp + 0.5 * av / m
    out = {"median_ratio": m, "cod": 100 * np.mean(abs(r - m)) / m, "prd": r.mean() / (av.sum() / sp.sum()), "prb": np.polyfit(x, y, 1)[0], "cov_iaao": r.std(ddof=1) / r.mean()}
    k = None if n < 20 else 2 if n <= 50 else 4 if n <= 500 else 10
    out["vei"] = None
    if k:
        parts = np.array_split(r[np.argsort(proxy, kind="stable")], k)
        if min(len(parts[0]), len(parts[-1])) >= 10:
            out["vei"] = 100 * (np.median(parts[-1]) - np.median(parts[0])) / m
    order = np.lexsort((-av, sp))
    gini = lambda v: (2 * np.sum(v * np.arange(1, n + 1)) / v.sum() - (n + 1)) / n
    out["mki"] = gini(av[order]) / gini(sp[order])
    return out


@pytest.mark.parametrize("n", [5, 19, 20, 50, 51, 500, 501])
def test_bundle_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    sp = np.exp(rng.normal(12, 0.6, n))
    av = sp**0.9 * 3 * np.exp(rng.normal(0, 0.15, n))
    row = ratio_study.bundle(frame(spark, av, sp).withColumn("g", F.lit(1)), ["g"], keys=["k"]).first()
    for name, value in numpy_study(av, sp).items():
        assert row[name] is None if value is None else math.isclose(row[name], value, rel_tol=1e-9), name


def test_proportional_values_are_neutral(spark):
    sp = np.linspace(50_000, 900_000, 60)
    row = ratio_study.bundle(frame(spark, 0.8 * sp, sp).withColumn("g", F.lit(1)), ["g"], keys=["k"]).first()
    assert row.prd == pytest.approx(1) and row.cod == pytest.approx(0, abs=1e-9) and row.mki == pytest.approx(1)
    assert row.prb == pytest.approx(0, abs=1e-9) and row.vei == pytest.approx(0, abs=1e-9)


def test_scale_of_values_does_not_matter(spark):
    rng = np.random.default_rng(3)
    sp = np.exp(rng.normal(12, 0.5, 80))
    av = sp * np.exp(rng.normal(0, 0.2, 80))
    df = frame(spark, av, sp).withColumn("g", F.lit(1))
    a, b = (ratio_study.bundle(df.withColumn("av", F.col("av") * c), ["g"], keys=["k"]).first() for c in (1.0, 3.7))
    for name in ("cod", "prd", "cov_iaao", "vei", "mki"):
        assert a[name] == pytest.approx(b[name], rel=1e-9)


def test_odd_values_are_left_out_and_undefined_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, float("nan"), 2.0), (1, 1.0, None), (1, float("inf"), 1.0), (1, -1.0, 1.0), (1, 0.0, 1.0), (1, 2.0, 4.0)], "g int, av double, sp double")
    row = ratio_study.accuracy(df, ["g"]).first()
    assert row.n == 2 and row.corr_r_price is None and row.var_ratio == 0
    assert ratio_study.vei(df, ["g"]).count() == 0
    assert ratio_study.prb(df.limit(1), ["g"]).first().prb is None
    assert ratio_study.bundle(df.limit(0), ["g"]).count() == 0
    assert ratio_study.cod(df).first().cod == 0


def test_positions_over_the_whole_table(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 7919 % 101)
    found = {(r.v, r.id): r.pos for r in with_position(df, ["v", "id"]).collect()}
    assert [found[k] for k in sorted(found)] == list(range(1, 1001))


def test_flags(spark):
    values = spark.createDataFrame([(1.0,), (1.11,), (1.2,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in values.select(flags.range_flag(F.col("x"), (0.9, 1.1), 0.02)).collect()] == ["PASS", "WARN", "FAIL", "NA", "NA"]
    cards = spark.createDataFrame([("a", 1.0), ("b", 4.0)], "m string, v double")
    assert {r.m: r.d_v for r in flags.delta_vs_baseline(cards, "m", "missing", ("v",)).collect()} == {"a": 0.0, "b": 3.0}
    assert {r.m: r.d_v for r in flags.delta_vs_baseline(cards, "m", "b", ("v",)).collect()} == {"a": -3.0, "b": 0.0}


def test_quantile_strata_match_right_closed_bins(spark):
    sp = np.arange(1, 101.0)
    sizes = ratio_study.quantile_report(frame(spark, sp * 1.1, sp), 4).orderBy("stratum").select("count").collect()
    assert [r[0] for r in sizes] == [25, 25, 25, 25]
    same = ratio_study.quantile_report(frame(spark, np.ones(10), np.ones(10)), 4).collect()
    assert [r["count"] for r in same] == [10]


def expanded(spark, seed):
    """Rows with weights, in groups of several sizes, one of them NULL, and the same rows copied."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in (("a", 900), ("b", 30), ("c", 12), (None, 60), ("flat", 40), ("one", 1)):
        for k in range(n):
            sp = 100.0 if g == "flat" else float(np.exp(rng.normal(12, 0.6)))
            rows.append((g, len(rows), sp, sp if g == "flat" else sp * float(rng.lognormal(0, 0.2)), int(rng.integers(0, 5))))
    rows.append(("bad", len(rows), -1.0, 5.0, 2))
    table = spark.createDataFrame(rows, "g string, k long, sp double, av double, mult long")
    copies = table.withColumn("copy", F.explode(F.expr("CASE WHEN mult > 0 THEN sequence(1, mult) ELSE array() END")))
    return table, copies


@pytest.mark.parametrize("limit", [None, 20])
def test_weighted_bundle_equals_the_bundle_of_copies(spark, monkeypatch, limit):
    table, copies = expanded(spark, 1)
    if limit:
        monkeypatch.setattr("ratiospark.operators.quantiles.IN_MEMORY", limit)
        monkeypatch.setattr("ratiospark.operators.positions.IN_MEMORY", limit)
    got = {r.g: r.asDict() for r in ratio_study.weighted_bundle(table, ["g"], "mult", keys=["k"]).collect()}
    want = {r.g: r.asDict() for r in ratio_study.bundle(copies, ["g"], keys=["k", "copy"]).collect()}
    assert set(got) == set(want) and None in got
    for g, row in want.items():
        assert set(got[g]) == set(row)
        for name, value in row.items():
            assert got[g][name] == (value if value is None or isinstance(value, str) else pytest.approx(value, rel=1e-8, abs=1e-9)), (g, name)
    assert want[None]["cod"] > 0 and want[None]["vei"] is not None and want[None]["mki"] > 0


def test_bundle_equals_its_parts(spark):
    _, copies = expanded(spark, 2)
    keys = ["k", "copy"]
    whole = {r.g: r for r in ratio_study.bundle(copies, ["g"], keys=keys).collect()}
    for part, names in ((ratio_study.cod(copies, ["g"]), ["cod"]), (ratio_study.prb(copies, ["g"]), ["prb"]), (ratio_study.vei(copies, ["g"], keys=keys), ["vei"]), (ratio_study.gini(copies, ["g"]), ["ki", "mki"]), (ratio_study.accuracy(copies, ["g"]), ["r2", "iqr_ratio", "y_q05"])):
        for r in part.collect():
            assert [r[c] for c in names] == [pytest.approx(whole[r.g][c]) if whole[r.g][c] is not None else None for c in names], (r.g, names)


@pytest.mark.parametrize("keys", [["k"], []])
def test_large_groups_are_not_put_in_order(spark, monkeypatch, keys):
    """Strata and Ginis of large groups by counting, equal to those of sorted groups; values repeat, and so do whole rows."""
    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][k % 3], k, float(np.round(np.exp(rng.normal(3, 0.5)))), float(np.round(np.exp(rng.normal(3, 0.5)), 1))) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, sp double, av double")
    df = df.unionByName(df.where("k % 2 = 0"))
    measures = ("vei_medians", "vei_counts")
    want = {r.g: r for r in ratio_study.bundle(df, ["g"], keys=keys).collect()}
    ends = {r.g: [r[c] for c in measures] for r in ratio_study.vei(df, ["g"], keys=keys).collect()}
    monkeypatch.setattr("ratiospark.operators.quantiles.IN_MEMORY", 100)
    monkeypatch.setattr("ratiospark.operators.positions.IN_MEMORY", 100)

    def ranged(*_):
        raise AssertionError("rows are dealt out by ranges")

    monkeypatch.setattr(type(df), "repartitionByRange", ranged)
    got = {r.g: r for r in ratio_study.bundle(df, ["g"], keys=keys).collect()}
    assert set(got) == set(want) == {"a", "b", None}
    for g, r in want.items():
        for name, value in r.asDict().items():
            assert got[g][name] == (value if isinstance(value, str | None) else pytest.approx(value, rel=1e-9, abs=1e-12)), (g, name)
    assert {r.g: [r[c] for c in measures] for r in ratio_study.vei(df, ["g"], keys=keys).collect()} == ends


def test_sales_are_not_gathered_by_brand(spark):
    """F12."""
    from oracle import SF

    from ratiospark.plans.bindings import sales

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(brand" not in sales(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [None, 20])
@pytest.mark.parametrize("only", [("cod", "prd", "prb"), ("vei",), ("mki", "iqr_ratio"), ("n", "median_ratio", "y_q05")])
def test_bundle_of_some_measures(spark, monkeypatch, only, limit):
    """those asked for are those of the whole bundle, and the other parts are not made."""
    _, copies = expanded(spark, 3)
    want = {r.g: r for r in ratio_study.bundle(copies, ["g"], keys=["k", "copy"]).collect()}
    if limit:
        monkeypatch.setattr("ratiospark.operators.quantiles.IN_MEMORY", limit)
        monkeypatch.setattr("ratiospark.operators.positions.IN_MEMORY", limit)
    made, gini, profile = [], ratio_study._gini, ratio_study._profile
    monkeypatch.setattr(ratio_study, "_gini", lambda *a: made.append("mki") or gini(*a))
    monkeypatch.setattr(ratio_study, "_profile", lambda *a: made.append("vei") or profile(*a))
    got = {r.g: r for r in ratio_study.bundle(copies, ["g"], keys=["k", "copy"], only=only).collect()}
    assert set(got) == set(want) and set(got["a"].asDict()) == {"g", "n", *only}
    assert made == [c for c in ("vei", "mki") if c in only]
    for g, r in want.items():
        assert [got[g][c] for c in ("n", *only)] == [None if r[c] is None else pytest.approx(r[c], rel=1e-9, abs=1e-12) for c in ("n", *only)], g


def test_cards_are_made_once(spark):
    """both sides of the differences, and the models and values of the turned table, read cards that were written."""
    cards = spark.range(40).groupBy((F.col("id") % 4).cast("string").alias("m")).agg(F.sum(F.col("id") * 1.0).alias("v"), F.max("id").alias("w"))
    for df, want in ((flags.delta_vs_baseline(cards, "m", "1", ("v",)), {"0": -10.0, "1": 0.0, "2": 10.0, "3": 20.0}), (flags.transposed(cards, "m", ("v", "w")), None)):
        assert "Range (" not in df._jdf.queryExecution().executedPlan().toString()
        if want:
            assert {r.m: r.d_v for r in df.collect()} == want
        else:
            assert {r.metric: (r["0"], r["3"]) for r in df.collect()} == {"v": (180.0, 210.0), "w": (36.0, 39.0)}


def test_bundle_joins_line_items_and_parts_once(spark, monkeypatch):
    """means and rows come from one join, which is read once and keeps its columns only; values are those of the lazy sales."""
    from oracle import SF

    from ratiospark.plans import bindings, catalogue

    columns = ["k1", "k2", "flag", "sp", "av"]
    kept = bindings.sales(spark, SF, ["k1", "k2", "flag"])
    assert set(kept.columns) == {*columns, "brand"}
    total = [F.count("*").alias("n"), F.sum(F.xxhash64(*(F.round(c, 6) if c == "av" else F.col(c) for c in columns)).cast("decimal(38,0)")).alias("h")]
    assert kept.agg(*total).first() == bindings.sales(spark, SF).agg(*total).first()
    joined, made = [], bindings.staged
    monkeypatch.setattr(bindings, "staged", lambda df: joined.append("l_partkey" in df._jdf.queryExecution().optimizedPlan().toString()) or made(df))
    out = catalogue.ratio_bundle_by_group(spark, SF)
    assert joined == [True, False]
    assert "l_partkey" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [None, 100])
def test_bundle_makes_only_the_end_strata(spark, monkeypatch, limit):
    """the VEI needs the first and the last stratum, so rows between them are dropped before their medians; values repeat at the cuts. Ginis without weights shuffle none."""
    rng = np.random.default_rng(6)
    rows = [(["a", "b", None][k % 3], k, float(np.round(np.exp(rng.normal(3, 0.5)))), float(np.round(np.exp(rng.normal(3, 0.5)), 1))) for k in range(1800)] + [("c", k, 10.0 + k % 4, 11.0) for k in range(30)]
    df = spark.createDataFrame(rows, "g string, k long, sp double, av double")
    want = {r.g: (r.vei, len(r.vei_medians), [r.vei_counts[0], r.vei_counts[-1]]) for r in ratio_study.vei(df, ["g"], keys=["k"]).collect()}
    assert {g: w[1] for g, w in want.items()} == {"a": 10, "b": 10, None: 10, "c": 2}
    if limit:
        monkeypatch.setattr("ratiospark.operators.quantiles.IN_MEMORY", limit)
        monkeypatch.setattr("ratiospark.operators.positions.IN_MEMORY", limit)
    made, found, gini, profile = {}, {}, ratio_study._gini, ratio_study._profile

    def kept(name, df):
        found[name] = df
        return df

    monkeypatch.setattr(ratio_study, "_profile", lambda *a: kept("vei", profile(*a)))
    monkeypatch.setattr(ratio_study, "_gini", lambda *a: kept("mki", gini(*a)))
    got = {r.g: r.vei for r in ratio_study.bundle(df, ["g"], keys=["k"], only=("vei", "mki")).collect()}
    for r in found["vei"].collect():
        made.setdefault(r.g, {})[r.stratum] = r["count"]
    assert {g: [v for _, v in sorted(m.items())] for g, m in made.items()} == {g: w[2] for g, w in want.items()}
    assert {g: sorted(m) for g, m in made.items()} == {g: [0, w[1] - 1] for g, w in want.items()}
    assert got == {g: w[0] if w[0] is None else pytest.approx(w[0], rel=1e-12) for g, w in want.items()}
    assert "_w#" not in found["mki"]._jdf.queryExecution().optimizedPlan().toString()
