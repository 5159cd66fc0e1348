"""Guideline flags, verdicts and scorecards of ratio studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratiospark.sources.staging import staged

# Guideline ranges and the margins of a warning.
LEVEL, PRD, PRB, PRB_OUTER, VEI = (0.90, 1.10), (0.98, 1.03), (-0.05, 0.05), (-0.10, 0.10), (-10.0, 10.0)
COD_RANGE = (5.0, 15.0)
MARGINS = {"level": 0.02, "prd": 0.02, "cod": 1.0, "prb": 0.01, "vei": 2.0}


def range_flag(value: Column, bounds: tuple[float, float], margin: float) -> Column:
    """NA for NULL or NaN; PASS inside, WARN within the margin, else FAIL."""
    low, high = bounds
    return F.when(value.isNull() | F.isnan(value), "NA").when(value.between(low, high), "PASS").when(value.between(low - margin, high + margin), "WARN").otherwise("FAIL")


def guidance_band(measure: str) -> tuple[float, float]:
    """V2: the stretch of a measure's deviation that plots shade: between the two ends' deviations from 1 (PRD), else from 0 to the farther end."""
    if measure == "prd":
        return tuple(sorted(round(abs(end - 1), 12) for end in PRD))
    return 0.0, max(map(abs, {"prb": PRB, "vei": VEI}[measure]))


def worst(*flags: Column) -> Column:
    """FAIL before WARN before PASS; NA if there is nothing else."""
    has = lambda word: reduce(lambda a, b: a | b, (f == word for f in flags))
    return F.when(has("FAIL"), "FAIL").when(has("WARN"), "WARN").when(has("PASS"), "PASS").otherwise("NA")


def interpretation(prd: Column, prb: Column, vei: Column) -> Column:
    """the direction each measure of vertical equity points to."""
    word = lambda c, low, high: F.when(c.isNull(), "undefined").when(c > high, "regressive").when(c < low, "progressive").otherwise("neutral")
    flip = lambda c, low, high: F.when(c.isNull(), "undefined").when(c < low, "regressive").when(c > high, "progressive").otherwise("neutral")
    return F.concat_ws("; ", F.concat(F.lit("PRD "), word(prd, *PRD)), F.concat(F.lit("PRB "), flip(prb, *PRB)), F.concat(F.lit("VEI "), flip(vei, *VEI)))


def scorecard(bundle: DataFrame, cod_range: tuple[float, float] = COD_RANGE) -> DataFrame:
    """flags of level, uniformity and vertical equity and the verdict, beside the measures."""
    level = worst(range_flag(F.col("median_ratio"), LEVEL, MARGINS["level"]), range_flag(F.col("wmean_ratio"), LEVEL, MARGINS["level"]))
    uniform = range_flag(F.col("cod"), cod_range, MARGINS["cod"])
    vertical = worst(range_flag(F.col("prd"), PRD, MARGINS["prd"]), range_flag(F.col("prb"), PRB, MARGINS["prb"]), range_flag(F.col("vei"), VEI, MARGINS["vei"]))
    return bundle.withColumns({"level": level, "uniformity": uniform, "vertical": vertical, "verdict": worst(level, uniform, vertical), "reading": interpretation(F.col("prd"), F.col("prb"), F.col("vei"))})


def delta_vs_baseline(cards: DataFrame, name: str, baseline: str | None, columns: tuple[str, ...]) -> DataFrame:
    """F8: differences from the named baseline, or from the first row by name where it is absent; the cards, which are needed twice, are made once."""
    cards = staged(cards)
    order = F.struct(F.when(F.col(name) == F.lit(baseline), 0).otherwise(1).alias("o"), F.col(name))
    base = cards.agg(*(F.min_by(c, order).alias(f"base_{c}") for c in columns))
    return cards.crossJoin(F.broadcast(base)).withColumns({f"d_{c}": F.col(c) - F.col(f"base_{c}") for c in columns}).drop(*(f"base_{c}" for c in columns))


def transposed(cards: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """measures as rows, models as columns; the cards, which are also asked for the models, are made once."""
    long = staged(cards.select(name, F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', cast({c} as double)" for c in columns) + ") as (metric, value)")))
    return long.groupBy("metric").pivot(name).agg(F.first("value"))
