import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratiospark.operators import bootstrap, folds, summary


def dates(spark, n=240):
    return spark.range(n).select(F.col("id").alias("k"), F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id / 2 as int) * 3)").alias("d"), (100 + F.col("id") % 17).cast("double").alias("sp"))


def test_months_are_clipped_to_their_last_day():
    assert folds.add_months(dt.date(2020, 1, 31), 1) == dt.date(2020, 2, 29)
    assert folds.add_months(dt.date(2019, 11, 30), 15) == dt.date(2021, 2, 28)


def test_mode_a():
    assert folds.mode_a_folds(100, 30, 0.2) == [(0, 0, 30, 50), (1, 0, 50, 70), (2, 0, 70, 90)]
    assert [f[1] for f in folds.mode_a_folds(100, 30, 0.2, sliding=True)] == [0, 20, 40]
    assert folds.mode_a_folds(10, 10, 0.5) == []
    with pytest.raises(ValueError):
        folds.mode_a_folds(10, 1, 1.5)


def test_mode_b_and_origins():
    made = folds.mode_b_folds(dt.date(2020, 1, 1), dt.date(2021, 12, 31), 12, 6, 6)
    assert made == [(0, dt.date(2020, 1, 1), dt.date(2021, 1, 1), dt.date(2021, 7, 1)), (1, dt.date(2020, 1, 1), dt.date(2021, 7, 1), dt.date(2022, 1, 1))]
    assert folds.rolling_origins(dt.date(2016, 2, 10), dt.date(2018, 1, 1)) == [dt.date(2016, 12, 1), dt.date(2017, 9, 1)]
    assert folds.sliding_starts(dt.date(2016, 2, 10), [dt.date(2021, 3, 1)]) == [(dt.date(2019, 1, 1), dt.date(2021, 3, 1))]


def test_membership_is_disjoint_and_ordered(spark):
    rows = dates(spark)
    table = spark.createDataFrame(folds.mode_a_folds(240, 100, 0.25), folds.FOLD_SCHEMA)
    from ratiospark.operators.positions import with_position

    found = folds.position_membership(with_position(rows, ["d", "k"]), table)
    assert found.groupBy("fold_id", "k").count().where("count > 1").count() == 0
    last = found.groupBy("fold_id").agg(F.max(F.when(F.col("role") == "train", F.col("pos"))).alias("a"), F.min(F.when(F.col("role") == "val", F.col("pos"))).alias("b")).collect()
    assert all(r.a + 1 == r.b for r in last) and len(last) == 2


def test_null_flags(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, bad boolean")
    assert [r.k for r in folds.valid_sales(df, ["bad"]).collect()] == [2]
    assert [r.k for r in folds.valid_sales(df, ["bad"], "keep").orderBy("k").collect()] == [2, 3]


def test_resamples_have_as_many_rows(spark):
    rows = bootstrap.in_blocks(dates(spark), "d", "month", ["k"])
    sizes = bootstrap.block_sizes(rows)
    drawn = bootstrap.draws([n for _, n in sizes], 5, bootstrap.random_picker(7, len(sizes)))
    found = bootstrap.multiplicity(spark, rows.select("block", "pos_in_block", "k", "sp"), [b for b, _ in sizes], drawn)
    assert {r.n for r in found.groupBy("bootstrap_id").agg(F.sum("mult").alias("n")).collect()} == {240}
    expanded = found.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("mult")))).withColumn("av", F.col("sp") + F.col("k") % 5)
    study = {r.bootstrap_id: r for r in bootstrap.weighted_study(found.withColumn("av", F.col("sp") + F.col("k") % 5)).collect()}
    for r in expanded.groupBy("bootstrap_id").agg(F.percentile(F.col("av") / F.col("sp"), 0.5).alias("m"), F.avg(F.col("av") / F.col("sp")).alias("a")).collect():
        assert study[r.bootstrap_id].median_ratio == pytest.approx(r.m) and study[r.bootstrap_id].mean_ratio == pytest.approx(r.a)


def test_one_block_is_the_sample():
    assert bootstrap.draws([10], 2, bootstrap.random_picker(1, 1)) == [(0, 0, 0, 10), (1, 0, 0, 10)]


def test_pareto_keeps_equal_points(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 0.5, 0.5), ("d", 0.5, 2.0), ("e", 2.0, 3.0)], "m string, gain double, loss double")
    assert sorted(r.m for r in summary.pareto_front(df, "gain", "loss").collect()) == ["a", "b", "c", "e"]
    assert summary.pareto_front(df.limit(0), "gain", "loss").count() == 0


def test_blend_drops_incomplete_rows(spark):
    p = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0)], "r int, c string, f double")
    w = spark.createDataFrame([("a", "1"), ("b", "3"), ("x", None), ("y", "bad")], "c string, weight string")
    assert [(r.r, r.blend) for r in summary.blended(p, w, "r", "c", "f").collect()] == [(1, 2.5)]


def test_median_of_a_large_resample_has_no_buffer_of_its_values(spark, monkeypatch):
    """F1."""
    from ratiospark.operators import quantiles

    rows = dates(spark).select("k", "sp", (F.col("sp") + F.col("k") % 5).alias("av"), (F.col("k") % 3).alias("bootstrap_id"), (1 + F.col("k") % 4).alias("mult"))
    want = {r.bootstrap_id: r for r in bootstrap.weighted_study(rows).collect()}
    monkeypatch.setattr(quantiles, "IN_MEMORY", 20)
    study = bootstrap.weighted_study(rows)
    assert "percentile" not in study._jdf.queryExecution().toString()
    for r in study.collect():
        assert all(getattr(r, c) == pytest.approx(getattr(want[r.bootstrap_id], c), rel=1e-12) for c in ("n", "median_ratio", "cod", "prd"))


def test_resamples_are_made_without_a_shuffle(spark):
    """counts follow from the draws; rows of a block drawn often and once cut."""
    from ratiospark.sources.staging import staged

    rows = staged(bootstrap.in_blocks(dates(spark), "d", "month", ["k"]).select("block", "pos_in_block", "k"))
    sizes = bootstrap.block_sizes(rows)
    drawn = bootstrap.draws([n for _, n in sizes], 4, bootstrap.random_picker(3, len(sizes)))
    found = bootstrap.multiplicity(spark, rows, [b for b, _ in sizes], drawn)
    assert "hashpartitioning" not in found._jdf.queryExecution().toString()
    want = {}
    for r in rows.collect():
        for b, _, block, take in drawn:
            if sizes[block][0] == r.block and r.pos_in_block < take:
                want[b, r.k] = want.get((b, r.k), 0) + 1
    assert {(r.bootstrap_id, r.k): r.mult for r in found.collect()} == want
