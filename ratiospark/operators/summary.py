"""Summaries of runs: means by configuration, top lists, grids, fronts, blends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.operators import flags, ratio_study
from ratiospark.sources.staging import staged


def by_config(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each metric."""
    return runs.groupBy(*keys).agg(*(f(m).alias(f"{m}_{s}") for m in metrics for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def deviations(runs: DataFrame) -> DataFrame:
    """Distances from neutral."""
    return runs.withColumns({"prd_dev": F.abs(F.col("prd") - 1), "prb_dev": F.abs(F.col("prb")), "vei_dev": F.abs(F.col("vei"))})


def top_configs(runs: DataFrame, key: str, metric: str, k: int) -> DataFrame:
    """The k configurations with the highest mean, ties by name."""
    return runs.groupBy(key).agg(F.avg(metric).alias("mean")).orderBy(F.desc("mean"), key).limit(k)


def selected_configs(runs: DataFrame, key: str, metric: str, k: int, baselines: Sequence[str]) -> DataFrame:
    """Baselines first, then the top configurations, each once."""
    base = runs.where(F.col(key).isin(*baselines)).select(key).distinct().withColumn("priority", F.lit(0))
    best = top_configs(runs, key, metric, k).select(key).withColumn("priority", F.lit(1))
    return base.unionByName(best).groupBy(key).agg(F.min("priority").alias("priority"))


def hardest_fold(runs: DataFrame, fold: str, metric: str) -> DataFrame:
    """The fold with the lowest mean, ties by number."""
    return runs.groupBy(fold).agg(F.avg(metric).alias("mean")).agg(F.min_by(fold, F.struct("mean", fold)).alias(fold), F.min("mean").alias("mean"))


def complete_grid(runs: DataFrame, fold: str, model: str) -> DataFrame:
    """Rows of the folds that have all models and of the models that have all folds; everything if none is left."""
    totals = runs.agg(F.count_distinct(fold).alias("folds"), F.count_distinct(model).alias("models"))
    full_folds = runs.groupBy(fold).agg(F.count_distinct(model).alias("k")).crossJoin(F.broadcast(totals)).where("k = models").select(fold)
    full_models = runs.groupBy(model).agg(F.count_distinct(fold).alias("k")).crossJoin(F.broadcast(totals)).where("k = folds").select(model)
    kept = runs.join(full_folds, fold, "left_semi").join(full_models, model, "left_semi")
    return runs if kept.isEmpty() else kept


def pareto_front(points: DataFrame, gain: str, loss: str) -> DataFrame:
    """Points no other point beats: as good in both and better in one; equal points stay together.

    Points are first cut to the least loss of each gain.  Gains are dealt out by
    ranges; a window finds the least loss above each in its range, and one row a
    range hands on what the ranges above have.
    """
    best = points.groupBy(gain).agg(F.min(loss).alias("_least"))
    ranged = staged(best.repartitionByRange(F.desc(gain)).withColumn("_part", F.spark_partition_id()))
    tops = ranged.groupBy("_part").agg(F.min("_least").alias("_top"))
    handed = tops.select("_part", F.min("_top").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_handed"))
    above = Window.partitionBy("_part").orderBy(F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1)
    front = ranged.withColumn("_here", F.min("_least").over(above)).join(F.broadcast(handed), "_part")
    front = front.withColumn("_above", F.least("_here", "_handed")).where("_above IS NULL OR _least < _above")
    return points.join(front.select(F.col(gain).alias("_g"), "_least"), (F.col(gain) == F.col("_g")) & (F.col(loss) == F.col("_least")), "left_semi")


def unpivoted(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form (keys, metric, value)."""
    parts = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    return df.select(*keys, F.expr(f"stack({len(metrics)}, {parts}) as (metric, value)"))


def evolution(boot: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and deviation of each metric by fold and configuration, long."""
    return unpivoted(boot, keys, metrics).groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def linear_ensemble(runs: DataFrame, weights: DataFrame, fold: str, key: str, metrics: Sequence[str]) -> DataFrame:
    """Weighted sums of metrics by fold; weights are one row a configuration."""
    joined = runs.join(weights, key)
    return joined.groupBy(fold).agg(*(F.sum(F.col("weight") * F.col(m)).alias(f"{m}_ensemble") for m in metrics))


def positive_weights(weights: DataFrame) -> DataFrame:
    """Text or missing weights count 0; positive ones stay, renormalised."""
    w = weights.withColumn("weight", F.coalesce(F.expr("try_cast(weight as double)"), F.lit(0.0))).where("weight > 0")
    total = w.agg(F.sum("weight").alias("_total"))
    return w.crossJoin(F.broadcast(total)).withColumn("weight", F.col("weight") / F.col("_total")).drop("_total")


def blended(predictions: DataFrame, weights: DataFrame, row: str, key: str, value: str, carry: Sequence[str] = (), others: Mapping[str, Column] | None = None) -> DataFrame:
    """Weighted predictions by row, with ``others``, aggregates of its configurations; rows without all configurations are dropped."""
    w = positive_weights(weights)
    needed = w.agg(F.count("*").alias("_needed"))
    out = predictions.join(F.broadcast(w), key).groupBy(row).agg(F.sum(F.col("weight") * F.col(value)).alias("blend"), F.count("*").alias("_have"), *(F.first(c).alias(c) for c in carry), *(v.alias(k) for k, v in (others or {}).items()))
    return out.crossJoin(F.broadcast(needed)).where("_have = _needed").drop("_have", "_needed")


def worst_period(rows: DataFrame, date: str, unit: str, score: Column, least: int = 2) -> DataFrame:
    """The calendar period with the lowest score among those of at least ``least`` rows."""
    per = rows.groupBy(F.date_trunc(unit, date).alias("period")).agg(F.count("*").alias("n"), score.alias("score")).where((F.col("n") >= least) & F.col("score").isNotNull() & ~F.isnan("score"))
    return per.orderBy("score", "period").limit(1)


def blend_study(rows: DataFrame, truth: str, blend: str, groups: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """K6: all measures of blended predictions; ``truth`` and ``blend`` are logs of prices."""
    return ratio_study.bundle(rows.withColumns({"sp": F.exp(truth), "av": F.exp(blend)}), groups, keys=keys)


def worst_study(rows: DataFrame, truth: str, blend: str, date: str, unit: str, keys: Sequence[str], accuracy: str = "r2", least: int = 2) -> DataFrame:
    """All measures of the calendar period with the lowest accuracy, among those of at least ``least`` rows where it is defined."""
    study = blend_study(rows.withColumn("period", F.date_trunc(unit, date)), truth, blend, ["period"], keys)
    return study.where((F.col("n") >= least) & F.col(accuracy).isNotNull() & ~F.isnan(accuracy)).orderBy(accuracy, "period").limit(1)


def tradeoff(points: DataFrame, key: str, gain: str, loss: str, baselines: Sequence[str]) -> DataFrame:
    """V2: plot data with the front and baselines marked."""
    front = pareto_front(points, gain, loss).select(key, F.lit(True).alias("is_pareto"))
    return points.join(front, key, "left").withColumns({"is_pareto": F.coalesce("is_pareto", F.lit(False)), "is_baseline": F.col(key).isin(*baselines)})


def banded_tradeoffs(means: DataFrame, key: str, gain: str, baselines: Sequence[str], measures: Sequence[str] = ("prd", "prb", "vei")) -> DataFrame:
    """V2: trade-off rows of each measure, long, with the guidance band of its deviation; ``means`` has a row a configuration with its gain and ``<measure>_dev``."""
    tables = []
    for measure in measures:
        points = means.select(key, F.col(gain).alias("gain"), F.col(f"{measure}_dev").alias("loss"))
        low, high = flags.guidance_band(measure)
        tables.append(tradeoff(points, key, "gain", "loss", baselines).withColumns({"measure": F.lit(measure), "band_lo": F.lit(low), "band_hi": F.lit(high), "within": F.col("loss") <= high}))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def pending(planned: DataFrame, status: DataFrame, key: str = "run_id") -> DataFrame:
    """Planned runs that no completed status row has."""
    return planned.join(status.where("status = 'completed'").select(key).distinct(), key, "left_anti")


def effective_improvement(before: Column, after: Column) -> Column:
    """Relative change, NULL from 0."""
    return F.try_divide(after - before, F.abs(before))
