"""Temporal validation sweeps: specs by folds, fitted on Spark, measured by grouped plans, resumable (C, D1, F11, K5, M26, R9, R10, S16-S18)."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiospark.functions.ids import run_id, stable_id
from ratiospark.operators import boosting, bootstrap, flags, folds, leafwise, linear, ratio_study, stacking, summary
from ratiospark.operators.positions import with_position
from ratiospark.sources import tables
from ratiospark.sources.staging import staged, unstaged


@dataclass(frozen=True)
class Spec:
    """A model configuration: ``fit`` takes training rows (features, y = log price) and returns a model with ``transform``."""

    name: str
    config: dict
    fit: Callable[[DataFrame], object]

    @property
    def config_id(self) -> str:
        return stable_id({"model": self.name, **self.config})


def default_specs(features: Sequence[str], rhos: Sequence[float] = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0), keeps: Sequence[float] = (0.3, 0.5, 0.7), categorical: Sequence[str] = (), plan: leafwise.TreePlan | None = None, **trees) -> list[Spec]:
    """Two baselines, each rho with the smooth and the covariance penalty, each rho and keep with the primal-dual one.

    With a ``plan``, trees grow leaf by leaf and know the ``categorical`` features; linear models take the others.
    """
    feats = tuple(f for f in features if f not in categorical)
    boost = lambda objective: lambda df: boosting.boost(df, feats, "y", objective, **trees)
    if plan is not None:
        boost = lambda objective: lambda df: leafwise.boost_leafwise(df, tuple(features), "y", objective, plan, categorical)
    out = [Spec("LinearRegression", {}, lambda df: linear.least_squares(df, feats, "y")), Spec("Boosting", {}, boost(boosting.squared_error()))]
    for rho in rhos:
        out += [Spec("BoostingSmooth", {"rho": rho}, boost(boosting.smooth_penalty(rho))), Spec("BoostingCov", {"rho": rho}, boost(boosting.covariance_penalty(rho)))]
    return out + [Spec("BoostingPrimalDual", {"rho": rho, "keep": keep}, boost(boosting.primal_dual(rho, keep))) for rho in rhos for keep in keeps]


@dataclass
class Protocol:
    """Roles of the columns and how to fold: Mode A by fraction, or by fixed windows where the fraction is 0."""

    date: str
    price: str
    key: Sequence[str]
    features: Sequence[str]
    initial_months: int = 12
    val_fraction: float = 0.1
    val_months: int = 3
    step_months: int = 3
    sliding: bool = False
    n_bootstrap: int = 20
    block: str = "month"
    seed: int = 2025
    extra: dict = field(default_factory=dict)

    def describe(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "extra"}


def folded(spark: SparkSession, rows: DataFrame, p: Protocol) -> DataFrame:
    """One row per fold and row with ``fold_id`` and ``role``."""
    if p.val_fraction > 0:
        n, initial = folds.initial_rows(rows, p.date, p.initial_months, 1)
        table = spark.createDataFrame(folds.mode_a_folds(n, initial, p.val_fraction, p.sliding), folds.FOLD_SCHEMA)
        return folds.position_membership(with_position(rows, [p.date, *p.key]), table)
    a, z = rows.agg(F.min(F.to_date(p.date)), F.max(F.to_date(p.date))).first()
    table = spark.createDataFrame(folds.mode_b_folds(a, z, p.initial_months, p.val_months, p.step_months, p.initial_months if p.sliding else None), folds.DATE_FOLD_SCHEMA)
    return folds.date_membership(rows, table, p.date)


def score(model: object, rows: DataFrame, p: Protocol) -> DataFrame:
    """Predictions on the price scale: (key, date, sp, av)."""
    out = model.transform(rows)
    return out.select(*p.key, F.col(p.date).alias("d"), F.exp("y").alias("sp"), F.exp("prediction").alias("av"))


@dataclass(frozen=True)
class Fold:
    """A fold as conditions on the rows, which are kept once however many folds they are in."""

    fold_id: int
    train: Column
    val: Column


def fold_conditions(rows: DataFrame, p: Protocol) -> tuple[DataFrame, list[Fold]]:
    """The rows, staged with their position where folds are by position, and the folds."""
    if p.val_fraction > 0:
        n, initial = folds.initial_rows(rows, p.date, p.initial_months, 1)
        at = F.col("pos") - 1
        made = [Fold(k, (at >= a) & (at < b), (at >= b) & (at < z)) for k, a, b, z in folds.mode_a_folds(n, initial, p.val_fraction, p.sliding)]
        return staged(with_position(rows, [p.date, *p.key])), made
    first, last = rows.agg(F.min(F.to_date(p.date)), F.max(F.to_date(p.date))).first()
    table = folds.mode_b_folds(first, last, p.initial_months, p.val_months, p.step_months, p.initial_months if p.sliding else None)
    d = F.to_date(p.date)
    return staged(rows), [Fold(k, (d >= a) & (d < b), (d >= b) & (d < z)) for k, a, b, z in table]


def content(rows: DataFrame, conditions: dict[str, Column], columns: Sequence[str]) -> dict[str, list]:
    """For each condition, the number of rows that meet it and two sums of their hashes: equal for equal rows in any order, in one pass."""
    of = F.xxhash64(*(F.col(c) for c in columns))
    aggs = []
    for when in conditions.values():
        aggs += [F.count(F.when(when, 1)), F.sum(F.when(when, of.cast("decimal(20,0)"))), F.bit_xor(F.when(when, of))]
    found = rows.agg(*(a.alias(f"c{k}") for k, a in enumerate(aggs))).first()
    return {name: [found[3 * k], str(found[3 * k + 1]), found[3 * k + 2]] for k, name in enumerate(conditions)}


def identities(rows: DataFrame, made: Sequence[Fold], p: Protocol, source: dict | None = None) -> tuple[str, str, list[tuple]]:
    """Ids of the data (its source and the values of the columns in use) and of the split (the protocol and the members of each fold), and the folds' record."""
    used = sorted({p.date, p.price, *p.key, *p.features})
    data = {"columns": used, "source": source or {}, "content": content(rows, {"all": F.lit(True)}, used)}
    members = content(rows, {f"{role}{f.fold_id}": getattr(f, role) for f in made for role in ("train", "val")}, [p.date, *p.key]) if made else {}
    record = [(f.fold_id, members[f"train{f.fold_id}"][0], members[f"val{f.fold_id}"][0], stable_id(members[f"train{f.fold_id}"]), stable_id(members[f"val{f.fold_id}"])) for f in made]
    return stable_id(data), stable_id({"protocol": p.describe(), "folds": record}), record


def temporal_cv(spark: SparkSession, rows: DataFrame, specs: Sequence[Spec], p: Protocol, root: str, source: dict | None = None, parallel: int = 4) -> None:
    """Fits every pending (spec, fold), writes folds, predictions, metrics, bootstrap and status below ``root``.

    A run is done if it is completed and its predictions are all there; others are
    fitted, and replace what they may have left.  Data and folds are known by their
    content, so other rows make other runs.  ``parallel`` runs are under way at a
    time, so that Spark fills the cores that one run's small jobs leave idle; a
    failed one does not stop the others.  Metrics are grouped plans over the predictions.
    """
    rows, made = fold_conditions(rows.withColumn("y", F.log(p.price)), p)
    data_id, split_id, record = identities(rows, made, p, source)
    fold_rows = spark.createDataFrame(record, "fold_id long, train_size long, val_size long, train_index_hash string, val_index_hash string")
    tables.replace_run(fold_rows.withColumns({"data_id": F.lit(data_id), "split_id": F.lit(split_id)}), f"{root}/folds", ("data_id", "split_id"))
    status_schema = "run_id string, config_id string, model_name string, fold_id long, status string, timestamp_utc string, error_type string, error_message string, traceback string"
    done = tables.intact_runs(spark, root)
    one_at_a_time = Lock()  # of appends to one folder

    def log(row: dict) -> None:
        names = [c.split()[0] for c in status_schema.split(", ")]
        with one_at_a_time:
            spark.createDataFrame([tuple(row.get(c) for c in names)], status_schema).write.mode("append").parquet(f"{root}/status")

    def fit(spec: Spec, fold: Fold) -> None:
        run = {"run_id": run_id(data_id, split_id, fold.fold_id, spec.config_id), "config_id": spec.config_id, "model_name": spec.name, "fold_id": fold.fold_id}
        if run["run_id"] in done:
            return

        def work() -> None:
            model = spec.fit(rows.where(fold.train))
            tags = {"data_id": data_id, "split_id": split_id, **run, "model_config_json": json.dumps(spec.config, sort_keys=True)}
            found = staged(score(model, rows.where(fold.val), p).withColumns({k: F.lit(v) for k, v in tags.items()}))
            with one_at_a_time:
                tables.replace_run(found, f"{root}/predictions")
                tables.replace_run(spark.createDataFrame([(run["run_id"], found.count())], "run_id string, n_rows long"), f"{root}/manifest")
            unstaged(found)

        tables.guarded(run, work, log)

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        for started in [pool.submit(inheritable_thread_target(spark)(fit), spec, fold) for spec in specs for fold in made]:
            started.result()
    unstaged(rows)
    predictions = spark.read.parquet(f"{root}/predictions").where((F.col("data_id") == data_id) & (F.col("split_id") == split_id))
    by = ["run_id", "config_id", "model_name", "fold_id"]
    ratio_study.bundle(predictions, by, keys=p.key).withColumns({"data_id": F.lit(data_id), "split_id": F.lit(split_id)}).write.mode("overwrite").parquet(f"{root}/runs")
    if p.n_bootstrap:
        bootstrapped(spark, predictions, p).write.mode("overwrite").parquet(f"{root}/bootstrap_metrics")


def bootstrapped(spark: SparkSession, predictions: DataFrame, p: Protocol) -> DataFrame:
    """All measures of each resample of each run; the draws of a fold are shared by its runs."""
    out = []
    for fold in sorted(r[0] for r in predictions.select("fold_id").distinct().collect()):
        own = predictions.where(F.col("fold_id") == fold)
        one = own.where(F.col("run_id") == own.agg(F.min("run_id")).first()[0])
        placed = bootstrap.in_blocks(one, "d", p.block, p.key)
        sizes = bootstrap.block_sizes(placed)
        drawn = bootstrap.draws([n for _, n in sizes], p.n_bootstrap, bootstrap.random_picker(p.seed + fold, len(sizes)))
        counts = bootstrap.multiplicity(spark, placed.select("block", "pos_in_block", *p.key), [b for b, _ in sizes], drawn)
        rows = own.join(counts.drop("block", "pos_in_block"), list(p.key))
        out.append(ratio_study.weighted_bundle(rows, ["run_id", "config_id", "model_name", "fold_id", "bootstrap_id"], "mult", keys=p.key))
    return tables.union_ragged(out)


def held_out(rows: DataFrame, test: DataFrame, specs: Sequence[Spec], p: Protocol) -> DataFrame:
    """Each spec fitted once on ``rows`` and measured on ``test``, with flags and verdicts."""
    train, test = (x.withColumn("y", F.log(p.price)) for x in (rows, test))
    scored = [score(s.fit(train), test, p).withColumns({"config_id": F.lit(s.config_id), "model_name": F.lit(s.name)}) for s in specs]
    return flags.scorecard(ratio_study.bundle(tables.union_ragged(scored), ["config_id", "model_name"], keys=p.key))


def cluster_routed(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame], object], cluster: str = "cluster", most: int = 100) -> DataFrame:
    """Each cluster's rows predicted by the model of that cluster; clusters without training rows give no predictions."""
    labels = sorted(r[0] for r in train.select(cluster).where(F.col(cluster).isNotNull()).distinct().limit(most + 1).collect())
    if len(labels) > most:
        raise ValueError(f"over {most} clusters")
    return tables.union_ragged([fit(train.where(F.col(cluster) == c)).transform(test.where(F.col(cluster) == c)) for c in labels])


def scatter_tables(predictions: DataFrame, cluster: str | None = None) -> tuple[DataFrame, DataFrame]:
    """V7: ratio, log ratio, residual and log residual by row, and their trend lines over price, overall or by cluster."""
    groups = [cluster] if cluster else []
    rows = predictions.select(*groups, "sp", "av", (F.col("av") / F.col("sp")).alias("ratio"), (F.log("av") - F.log("sp")).alias("log_ratio"), (F.col("av") - F.col("sp")).alias("residual"), (F.log("sp") - F.log("av")).alias("log_residual"))
    lines = [ratio_study.line_fit(rows, groups, y, "sp").withColumn("y", F.lit(y)) for y in ("ratio", "log_ratio", "residual", "log_residual")]
    return rows, tables.union_ragged(lines)


def parameter_series(runs: DataFrame, parameter: str, metrics: Sequence[str]) -> DataFrame:
    """V8, V9: mean and deviation of metrics along a parameter of the configuration."""
    valued = runs.withColumn(parameter, F.get_json_object("model_config_json", f"$.{parameter}").cast("double"))
    return summary.evolution(valued, ["model_name", parameter], metrics)


def stacked(spark: SparkSession, root: str, accuracy: str = "r2", prd: tuple[float, float] = (0.98, 1.03)) -> tuple[DataFrame, DataFrame]:
    """K1-K5: (weights, ensemble metrics by fold) of the runs below ``root``."""
    done = spark.read.parquet(f"{root}/runs")
    weights = stacking.optimise(done, "fold_id", "config_id", accuracy, {"prd": prd})
    return weights, summary.linear_ensemble(done, weights, "fold_id", "config_id", tuple(dict.fromkeys((accuracy, "r2", "prd", "prb", "vei"))))


def analysis(spark: SparkSession, root: str, k: int = 5, baselines: Sequence[str] = ("LinearRegression", "Boosting")) -> dict[str, DataFrame]:
    """V1-V6: the tables of an analysis of the runs below ``root``."""
    done = spark.read.parquet(f"{root}/runs")
    boot = tables.read_dataset(spark, f"{root}/bootstrap_metrics", "fold_id long, config_id string, model_name string, cod double, prd double")
    means = done.groupBy("config_id", "model_name").agg(F.avg("r2").alias("r2"), F.avg(F.abs(F.col("prd") - 1)).alias("prd_dev"))
    names = [r[0] for r in means.where(F.col("model_name").isin(*baselines)).select("config_id").collect()]
    return {
        "summary": summary.by_config(summary.deviations(done), ["config_id", "model_name"], ("r2", "prd", "prb", "vei", "cod", "prd_dev", "prb_dev", "vei_dev")),
        "selected": summary.selected_configs(done, "config_id", "r2", k, names),
        "hardest_fold": summary.hardest_fold(done, "fold_id", "r2"),
        "tradeoff": summary.tradeoff(means, "config_id", "r2", "prd_dev", names),
        "evolution": summary.evolution(boot, ["fold_id", "config_id", "model_name"], ("cod", "prd")),
    }
