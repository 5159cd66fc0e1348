"""Feature operators, each a ``fit`` that reads statistics by Spark aggregates and a ``transform`` of column expressions.

Fitted dictionaries (categories, means) stay tables and are joined; only scalars
by column come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratiospark.operators.quantiles import quantiles

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


class Step:
    """Base: columns that are absent are skipped."""

    def fit(self, df: DataFrame) -> Step:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass
class ColumnPruner(Step):
    """Outcome, predictors and ids, less the dropped, in the input's order."""

    keep: Sequence[str]
    drop: Sequence[str] = ("time_split",)

    def transform(self, df):
        return df.select(*(c for c in df.columns if c in self.keep and c not in self.drop))


@dataclass
class CategoryCoder(Step):
    """NULL becomes "unknown", a value not fitted becomes "new"."""

    columns: Sequence[str]
    known: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df):
        self.known = {c: df.select(F.col(c).cast("string").alias(c)).where(F.col(c).isNotNull()).distinct() for c in self.columns if c in df.columns}
        return self

    def transform(self, df):
        for c, values in self.known.items():
            if c in df.columns:
                hit = values.select(F.col(c).alias("_v"))
                df = df.join(hit, F.col(c).cast("string") == F.col("_v"), "left")
                df = df.withColumn(c, F.when(F.col(c).isNull(), "unknown").when(F.col("_v").isNull(), "new").otherwise(F.col("_v"))).drop("_v")
        return df


@dataclass
class NovelCategories(Step):
    """A value not fitted becomes "unknown"; NULL stays."""

    columns: Sequence[str]
    known: dict[str, DataFrame] = field(default_factory=dict)

    fit = CategoryCoder.fit

    def transform(self, df):
        for c, values in self.known.items():
            if c in df.columns:
                df = df.join(values.select(F.col(c).alias("_v")), F.col(c).cast("string") == F.col("_v"), "left")
                df = df.withColumn(c, F.when(F.col(c).isNotNull() & F.col("_v").isNull(), "unknown").otherwise(F.col(c).cast("string"))).drop("_v")
        return df


@dataclass
class Imputer(Step):
    """NULL and NaN become the exact median, or the mode (least value on ties)."""

    numeric: Sequence[str] = ()
    nominal: Sequence[str] = ()
    values: dict[str, object] = field(default_factory=dict)

    def fit(self, df):
        clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        medians = {c: (clean(c), 0.5) for c in self.numeric if c in df.columns}
        modes = {c: F.mode(c, True) for c in self.nominal if c in df.columns}
        self.values = quantiles(df, (), medians, modes).first().asDict() if medians or modes else {}
        return self

    def transform(self, df):
        for c, v in self.values.items():
            if c in df.columns and v is not None:
                missing = F.col(c).isNull() | (F.isnan(F.col(c).cast("double")) if c in self.numeric else F.lit(False))
                df = df.withColumn(c, F.when(missing, F.lit(v)).otherwise(F.col(c)))
        return df


@dataclass
class InitialDropper(Step):
    """Drops text location columns (but school districts), time_split and what is no predictor."""

    predictors: Sequence[str]

    def transform(self, df):
        text = {c for c, t in df.dtypes if t not in NUMERIC}
        bad = lambda c: c == "time_split" or c not in self.predictors or (c.startswith("loc_") and not c.startswith("loc_school_") and c in text)
        return df.drop(*(c for c in df.columns if bad(c)))


@dataclass
class TypeConverter(Step):
    """E5: a zero floor area becomes 1; flags and ``ind_``/``ccao_is`` columns become numbers, NULL if unreadable."""

    area: Sequence[str] = ("char_bldg_sf",)
    flags: Sequence[str] = ()
    prefixes: tuple[str, ...] = ("ind_", "ccao_is")

    def transform(self, df):
        for c in df.columns:
            if c in self.area:
                df = df.withColumn(c, F.when(F.col(c) == 0, 1).otherwise(F.col(c)))
            elif c in self.flags or c.startswith(self.prefixes):
                kind = dict(df.dtypes)[c]
                df = df.withColumn(c, F.col(c).cast("int").cast("double") if kind == "boolean" else F.expr(f"try_cast({c} as double)"))
        return df


@dataclass
class TargetEncoder(Step):
    """A category becomes the mean target of its rows, others the global mean; ``smoothing`` rows of prior, 0 for none."""

    columns: Sequence[str]
    target: str
    smoothing: float = 0.0
    means: dict[str, DataFrame] = field(default_factory=dict)
    overall: float = 0.0

    def fit(self, df):
        self.overall = df.agg(F.avg(self.target)).first()[0]
        prior = F.lit(self.smoothing * (self.overall or 0.0))
        self.means = {c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(((F.sum(self.target) + prior) / (F.count(self.target) + self.smoothing)).alias("_m")) for c in self.columns if c in df.columns}
        return self

    def transform(self, df):
        for c, table in self.means.items():
            df = df.join(table, F.col(c) == F.col("_v"), "left").withColumn(c, F.coalesce("_m", F.lit(self.overall))).drop("_v", "_m")
        return df


@dataclass
class OneHot(Step):
    """A column of 0 and 1 for each fitted value; none for others."""

    columns: Sequence[str]
    limit: int = 1000
    values: dict[str, list] = field(default_factory=dict)

    def fit(self, df):
        for c in self.columns:
            found = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(self.limit + 1).collect()]
            if len(found) > self.limit:
                raise ValueError(f"{c} has over {self.limit} values; encode it otherwise")
            self.values[c] = found
        return self

    def transform(self, df):
        made = {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c, vs in self.values.items() for v in vs}
        return df.withColumns(made).drop(*self.values) if made else df


@dataclass
class Winsorizer(Step):
    """Held between two exact quantiles."""

    columns: Sequence[str]
    low: float = 0.01
    high: float = 0.99
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df):
        there = [c for c in self.columns if c in df.columns]
        row = quantiles(df, (), {f"{e}_{c}": (F.col(c), q) for c in there for e, q in (("low", self.low), ("high", self.high))}).first() if there else {}
        self.bounds = {c: (row[f"low_{c}"], row[f"high_{c}"]) for c in there if row[f"low_{c}"] is not None}
        return self

    def transform(self, df):
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in self.bounds.items() if c in df.columns})


@dataclass
class PowerFeatures(Step):
    """Shifted columns, Box-Cox on positive rows by the likeliest lambda, then squares.

    The profile likelihood of a grid of lambdas is one aggregate; the grid is
    refined around its best twice.
    """

    shifted: Sequence[str] = ()
    box_cox: Sequence[str] = ()
    squared: Sequence[str] = ()
    lambdas: dict[str, float] = field(default_factory=dict)

    def fit(self, df):
        df = self._shift(df)
        for c in self.box_cox:
            low, high = -3.0, 3.0
            for _ in range(4):
                grid = np.linspace(low, high, 13)
                x = F.when(F.col(c) > 0, F.col(c).cast("double"))
                moved = lambda lam: F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(float(lam))) - 1) / float(lam)
                n = F.count(x)
                row = df.agg(*(((float(lam) - 1) * F.sum(F.log(x)) - n / 2 * F.log(F.var_pop(moved(lam)))).alias(f"l{k}") for k, lam in enumerate(grid))).first()
                scores = [v if v is not None else -np.inf for v in row]
                best = int(np.argmax(scores))
                low, high = grid[max(0, best - 1)], grid[min(12, best + 1)]
            self.lambdas[c] = float((low + high) / 2)
        return self

    def _shift(self, df):
        return df.withColumns({f"{c}_1": F.col(c) + 0.001 for c in self.shifted if c in df.columns})

    def transform(self, df):
        df = self._shift(df)
        for c, lam in self.lambdas.items():
            moved = F.log(F.col(c)) if abs(lam) < 1e-9 else (F.pow(F.col(c), F.lit(lam)) - 1) / lam
            df = df.withColumn(c, F.when(F.col(c) > 0, moved).otherwise(F.col(c)))
        return df.withColumns({f"{c}^2": F.col(c) * F.col(c) for c in self.squared if c in df.columns})


@dataclass
class Scaler(Step):
    """Numeric columns of the prefixes, less ids, to mean 0 and population deviation 1; constants only centred."""

    prefixes: tuple[str, ...] = ("",)
    ids: Sequence[str] = ()
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df):
        there = [c for c in numeric_columns(df) if c.startswith(self.prefixes) and c not in self.ids]
        row = df.agg(*(f(c).alias(f"{k}_{c}") for c in there for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first() if there else {}
        self.stats = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in there if row[f"m_{c}"] is not None}
        return self

    def transform(self, df):
        return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.stats.items() if c in df.columns})


@dataclass
class NearZeroVariance(Step):
    """Drops columns with one value, NULL counting as a value."""

    dropped: list[str] = field(default_factory=list)

    def fit(self, df):
        # Distinct up to two is what counts: least, greatest and whether NULLs and others meet.
        row = df.agg(*(x for c in df.columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count(c).alias(f"n_{c}"))), F.count("*").alias("_n")).first()
        self.dropped = [c for c in df.columns if row[f"n_{c}"] == 0 or (row[f"lo_{c}"] == row[f"hi_{c}"] and row[f"n_{c}"] == row["_n"])]
        return self

    def transform(self, df):
        return df.drop(*self.dropped)


@dataclass
class Recipe(Step):
    """Steps one after the other, each fitted on what the one before returns."""

    steps: Sequence[Step]

    def fit(self, df):
        for step in self.steps:
            df = step.fit(df).transform(df)
        return self

    def transform(self, df):
        for step in self.steps:
            df = step.transform(df)
        return df


def main_recipe(outcome: str, predictors: Sequence[str], categorical: Sequence[str], ids: Sequence[str] = (), numeric: Sequence[str] = ()) -> Recipe:
    """E14, and E15 if ``numeric`` columns are to be imputed."""
    steps: list[Step] = [ColumnPruner([outcome, *predictors, *ids]), CategoryCoder(categorical)]
    return Recipe([*steps, Imputer(numeric)] if numeric else steps)


def linear_recipe(outcome: str, predictors: Sequence[str], categorical: Sequence[str], numeric: Sequence[str], one_hot: Sequence[str] = (), winsorized: Sequence[str] = (), shifted: Sequence[str] = (), box_cox: Sequence[str] = (), squared: Sequence[str] = (), scaled: tuple[str, ...] = ("",), target_encoding: bool = True) -> Recipe:
    """E16, or E17 without target encoding; the order of the steps matters."""
    encoded = [c for c in categorical if c not in one_hot]
    steps: list[Step] = [InitialDropper([outcome, *predictors]), TypeConverter(), Imputer(numeric, categorical)]
    steps += [TargetEncoder(encoded, outcome)] if target_encoding else []
    steps += [NovelCategories(one_hot), OneHot(one_hot), Winsorizer(winsorized), PowerFeatures(shifted, box_cox, squared), Scaler(scaled, ids=(outcome,)), NearZeroVariance()]
    return Recipe(steps)


def cluster_labels(train: DataFrame, other: DataFrame, columns: Sequence[str], k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Standardised columns to k-means labels, fitted on ``train``; a row with a NULL among the columns stays, without a label."""
    whole = lambda df: df.na.drop(subset=list(columns))
    stages = [VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="error"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True), KMeans(k=k, seed=seed, featuresCol="_std", predictionCol="cluster")]
    model = Pipeline(stages=stages).fit(whole(train))
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns))
    return tuple(model.transform(whole(x)).drop("_raw", "_std").unionByName(x.where(missing).withColumn("cluster", F.lit(None).cast("int"))) for x in (train, other))
