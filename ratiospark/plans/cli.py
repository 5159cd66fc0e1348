"""Command line: cv, test, stack, analyse; values from the command line, then the YAML file, then defaults (C)."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ratiospark.operators import folds, leafwise
from ratiospark.plans import experiment
from ratiospark.sources import tables
from ratiospark.sources.staging import staging

DEFAULTS = {"initial_months": 12, "val_fraction": 0.1, "val_months": 3, "step_months": 3, "n_bootstrap": 20, "block": "month", "seed": 2025, "rounds": 20, "depth": 3, "leaves": 0, "max_models": 100, "top_k": 5, "parallel": 4, "prd_low": 0.98, "prd_high": 1.03, "accuracy": "r2"}
#: Grids of the default configurations; an empty one leaves its models out.
GRIDS = {"rhos": (0.1, 0.3, 1.0, 3.0, 10.0, 30.0), "keeps": (0.3, 0.5, 0.7)}


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    """Two passes: the first finds the configuration file, the second takes its values as defaults."""
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default="cv_config.yaml")
    path = first.parse_known_args(argv)[0].config
    read = tables.read_yaml(path)
    known = DEFAULTS | {k: v for k, v in read.items() if k in DEFAULTS}
    p = argparse.ArgumentParser(parents=[first], description=__doc__)
    p.add_argument("command", choices=("cv", "test", "stack", "analyse"))
    p.add_argument("--data", help="Parquet table of sales")
    p.add_argument("--root", required=True, help="folder of runs and results")
    for name in ("date", "price"):
        p.add_argument(f"--{name}", default=name)
    for name in ("key", "features", "flags", "categorical"):
        p.add_argument(f"--{name}", nargs="*", default=[])
    p.add_argument("--sliding", action="store_true")
    for k, v in known.items():
        p.add_argument(f"--{k.replace('_', '-')}", type=type(DEFAULTS[k]), default=v)
    for k, v in GRIDS.items():
        p.add_argument(f"--{k}", type=float, nargs="*", default=list(read.get(k, v)))
    return p.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("ratiospark").getOrCreate()
    with staging(spark):
        _run(spark, a)


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command in ("cv", "test"):
        rows = tables.read_table(spark, a.data, [*dict.fromkeys([a.date, a.price, *a.key, *a.features, *a.categorical, *a.flags])])
        rows = folds.valid_sales(rows, a.flags)
        features = [*a.features, *a.categorical]
        p = experiment.Protocol(a.date, a.price, a.key, features, a.initial_months, a.val_fraction, a.val_months, a.step_months, a.sliding, a.n_bootstrap, a.block, a.seed)
        trees = {"plan": leafwise.TreePlan(rounds=a.rounds, leaves=a.leaves), "categorical": a.categorical} if a.leaves else {"categorical": a.categorical, "rounds": a.rounds, "depth": a.depth}
        specs = experiment.default_specs(features, a.rhos, a.keeps, **trees)[: a.max_models]
        split = folds.time_holdout(rows, a.date, a.key)
        train, test = split.where("is_train").drop("is_train", "pos"), split.where("NOT is_train").drop("is_train", "pos")
        if a.command == "cv":
            experiment.temporal_cv(spark, train, specs, p, a.root, {"path": a.data, "flags": a.flags}, a.parallel)
        else:
            tables.write_csv(experiment.held_out(train, test, specs, p), f"{a.root}/test_metrics")
    elif a.command == "stack":
        weights, by_fold = experiment.stacked(spark, a.root, a.accuracy, (a.prd_low, a.prd_high))
        tables.write_csv(weights, f"{a.root}/weights")
        tables.write_csv(by_fold, f"{a.root}/fold_ensemble")
    else:
        for name, df in experiment.analysis(spark, a.root, a.top_k).items():
            tables.write_csv(df, f"{a.root}/analysis/{name}")


if __name__ == "__main__":
    main()
