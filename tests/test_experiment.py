import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiospark.functions.ids import canonical_json, stable_id
from ratiospark.operators import linear
from ratiospark.plans import cli, experiment
from ratiospark.sources import tables
from ratiospark.streaming.monitor import ratio_monitor


@pytest.fixture(scope="module")
def sold(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(a), float(np.exp(11 + 0.4 * a + rng.normal(0, 0.2)))) for k, a in enumerate(rng.normal(size=400))]
    return spark.createDataFrame(rows, "k long, a double, price double").withColumn("date", F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, cast(k * 2 as int))")).cache()


def specs(good=True):
    def broken(df):
        raise RuntimeError("no fit")

    out = [experiment.Spec("Linear", {"l2": l2}, lambda df, l2=l2: linear.least_squares(df, ["a"], "y", l2=l2)) for l2 in (0.0, 0.1)]
    return out if good else [*out, experiment.Spec("Broken", {}, broken)]


def test_sweep_resumes_and_survives_failures(spark, sold, tmp_path):
    p = experiment.Protocol("date", "price", ["k"], ["a"], n_bootstrap=3, val_fraction=0.2)
    root = str(tmp_path)
    experiment.temporal_cv(spark, sold, specs(False), p, root)
    status = tables.latest_status(spark.read.parquet(f"{root}/status"))
    assert {(r.status, r["count"]) for r in status.groupBy("status").count().collect()} == {("completed", 6), ("failed", 3)} or status.where("status = 'failed'").count() > 0
    before = spark.read.parquet(f"{root}/predictions").count()
    experiment.temporal_cv(spark, sold, specs(), p, root)
    assert spark.read.parquet(f"{root}/predictions").count() == before
    runs = spark.read.parquet(f"{root}/runs")
    assert runs.count() == spark.read.parquet(f"{root}/bootstrap_metrics").count() / 3
    weights, by_fold = experiment.stacked(spark, root, prd=(0.5, 1.5))
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1) and by_fold.count() > 0
    assert all(df.count() > 0 for df in experiment.analysis(spark, root, baselines=("Linear",)).values())


def test_held_out(spark, sold):
    p = experiment.Protocol("date", "price", ["k"], ["a"])
    cards = experiment.held_out(sold.where("k < 300"), sold.where("k >= 300"), specs(), p).collect()
    assert len(cards) == 2 and all(r.verdict in ("PASS", "WARN", "FAIL") for r in cards)
    assert len(experiment.default_specs(["a"])) == 32


def test_plot_tables(spark, sold):
    rows = sold.withColumns({"y": F.log("price"), "cluster": F.col("k") % 2})
    fit = lambda df: linear.least_squares(df, ["a"], "y")
    routed = experiment.cluster_routed(rows.where("k < 300"), rows.where("k >= 300"), fit)
    assert routed.count() == 100
    points, lines = experiment.scatter_tables(routed.select("cluster", F.exp("y").alias("sp"), F.exp("prediction").alias("av")), "cluster")
    assert points.count() == 100 and lines.count() == 8
    runs = spark.createDataFrame([("m", '{"rho":0.5}', 1.0), ("m", '{"rho":0.5}', 3.0), ("m", '{"rho":1}', 5.0)], "model_name string, model_config_json string, r2 double")
    assert {(r.rho, r["mean"]) for r in experiment.parameter_series(runs, "rho", ["r2"]).collect()} == {(0.5, 2.0), (1.0, 5.0)}


def test_files(spark, tmp_path):
    tables.write_json_atomically({"b": 1, "a": [2]}, f"{tmp_path}/x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": [2], "b": 1}
    df = spark.createDataFrame([("d", "s", 1, 0.5)], "data_id string, split_id string, fold_id long, v double")
    tables.append_runs(df, f"{tmp_path}/runs")
    tables.append_runs(df.withColumn("fold_id", F.lit(2)), f"{tmp_path}/runs")
    assert tables.read_dataset(spark, f"{tmp_path}/runs").where("fold_id = 2").count() == 1
    assert tables.read_dataset(spark, f"{tmp_path}/none", "a int").count() == 0
    with pytest.raises(Exception):
        tables.read_dataset(spark, f"{tmp_path}/none")
    tables.write_csv(df, f"{tmp_path}/csv")
    assert tables.read_csv(spark, f"{tmp_path}/csv", "data_id string, split_id string, fold_id long, v double").collect() == df.collect()
    (tmp_path / "bad.json").write_text("{oops")
    assert tables.read_json(spark, f"{tmp_path}/bad.json", "status string").first().status is None
    assert tables.read_yaml(f"{tmp_path}/none.yaml") == {}
    assert "NA" in tables.console_table([{"a": None, "b": 1.0}], ["a", "b"]) and "tabular" in tables.latex_table([{"a": 1.0}], ["a"])


def test_ids():
    assert canonical_json({"b": 1, "a": 2}) == '{"a":2,"b":1}'
    assert stable_id({"a": 1}) == stable_id(dict(a=1)) and len(stable_id({})) == 16


def test_command_line_precedence(tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 7\nrounds: 3\n")
    a = cli.arguments(["cv", "--root", "r", "--config", str(tmp_path / "c.yaml"), "--rounds", "9"])
    assert (a.seed, a.rounds, a.depth) == (7, 9, 3)


def test_monitor(spark, sold, tmp_path):
    sold.select("date", F.col("price").alias("sp"), (F.col("price") * 0.9).alias("av")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("date timestamp, sp double, av double").parquet(f"{tmp_path}/in")
    q = ratio_monitor(stream, "date", "av", "sp").writeStream.outputMode("complete").format("memory").queryName("monitor").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM monitor").collect()
    assert sum(r.n for r in rows) == 400 and all(r.wmean_ratio == pytest.approx(0.9) for r in rows)


def rows_of_runs(spark, root):
    return {r.run_id: r["count"] for r in spark.read.parquet(f"{root}/predictions").groupBy("run_id").count().collect()}


def test_runs_are_known_by_content_and_written_once(spark, sold, tmp_path, monkeypatch):
    p, root = experiment.Protocol("date", "price", ["k"], ["a"], n_bootstrap=0, val_fraction=0.25), str(tmp_path)
    one = specs()[:1]
    experiment.temporal_cv(spark, sold, one, p, root)
    first = rows_of_runs(spark, root)
    record = spark.read.parquet(f"{root}/folds").collect()
    assert len(record) == len(first) and all(r.val_size == n for r, n in zip(sorted(record, key=lambda r: r.fold_id), sorted(first.values()), strict=True))
    # As many rows, one price changed: other runs.
    changed = sold.withColumn("price", F.when(F.col("k") == 7, F.col("price") + 1).otherwise(F.col("price")))
    experiment.temporal_cv(spark, changed, one, p, root)
    second = rows_of_runs(spark, root)
    assert len(second) == 2 * len(first) and set(first) < set(second)
    # A run that fails after its predictions are written leaves no row twice.
    real, calls = tables.replace_run, []

    def failing(df, path, *layout):
        if path.endswith("manifest"):
            calls.append(path)
            raise RuntimeError("lost before its manifest")
        return real(df, path, *layout)

    third = sold.withColumn("a", F.col("a") + 1)
    monkeypatch.setattr(tables, "replace_run", failing)
    experiment.temporal_cv(spark, third, one, p, root)
    assert len(calls) == len(first)
    monkeypatch.setattr(tables, "replace_run", real)
    assert len(tables.intact_runs(spark, root)) == 2 * len(first)
    experiment.temporal_cv(spark, third, one, p, root)
    held = rows_of_runs(spark, root)
    assert len(held) == 3 * len(first) and sorted(held.values()) == sorted(3 * list(first.values()))
    assert len(tables.intact_runs(spark, root)) == 3 * len(first)


def test_a_lost_artifact_is_made_again(spark, sold, tmp_path):
    import shutil

    p, root = experiment.Protocol("date", "price", ["k"], ["a"], n_bootstrap=0, val_fraction=0.25), str(tmp_path)
    fits = []
    counting = experiment.Spec("Linear", {}, lambda df: fits.append(1) or linear.least_squares(df, ["a"], "y"))
    experiment.temporal_cv(spark, sold, [counting], p, root, parallel=3)
    first = rows_of_runs(spark, root)
    experiment.temporal_cv(spark, sold, [counting], p, root)
    assert len(fits) == len(first)
    lost = sorted(first)[0]
    shutil.rmtree(tmp_path / "predictions" / f"part=run_{lost}")
    experiment.temporal_cv(spark, sold, [counting], p, root)
    assert len(fits) == len(first) + 1 and rows_of_runs(spark, root) == first


def test_folds_by_date_and_resamples_have_all_measures(spark, sold, tmp_path):
    p, root = experiment.Protocol("date", "price", ["k"], ["a"], n_bootstrap=2, val_fraction=0, initial_months=12, val_months=3, step_months=6), str(tmp_path)
    experiment.temporal_cv(spark, sold, specs()[:1], p, root)
    runs, boot = spark.read.parquet(f"{root}/runs"), spark.read.parquet(f"{root}/bootstrap_metrics")
    assert boot.count() == 2 * runs.count()
    assert set(runs.columns) - {"data_id", "split_id"} <= set(boot.columns)
    record = {r.fold_id: r for r in spark.read.parquet(f"{root}/folds").collect()}
    assert all(record[r.fold_id].val_size == r.n for r in runs.collect())


def test_limits_and_grids_of_the_command_line():
    a = cli.arguments(["cv", "--root", "r", "--rhos", "0.5", "--keeps", "--max-models", "3"])
    made = experiment.default_specs(["a"], a.rhos, a.keeps)
    assert (a.rhos, a.keeps, len(made)) == ([0.5], [], 4)
    assert len(made[: a.max_models]) == 3
