"""A ratio monitor over a stream of sales: sums by window, from which the weighted mean ratio and PRD follow.

An extension: medians, and what rests on them, are left to batch studies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratiospark.functions.numeric import positive, ratio


def ratio_monitor(stream: DataFrame, time: str, av: str, sp: str, window: str = "30 days", late: str = "7 days") -> DataFrame:
    """Count, mean ratio, weighted mean ratio and PRD by window; rows later than ``late`` are left out, state is one row a window."""
    rows = stream.where(positive(av) & positive(sp)).withWatermark(time, late)
    out = rows.groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(F.col(av) / F.col(sp)).alias("mean_ratio"), ratio(F.sum(av), F.sum(sp)).alias("wmean_ratio"))
    return out.select("window.start", "window.end", "n", "mean_ratio", "wmean_ratio", ratio("mean_ratio", "wmean_ratio").alias("prd"))
