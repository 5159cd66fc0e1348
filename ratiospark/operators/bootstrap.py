"""Time-block bootstrap by multiplicity.

A resample is not rows copied but a count for each row: blocks of calendar time are
drawn with replacement until they hold n rows, the last one cut.  Draws are a small
table made on the driver from the blocks' sizes; counts follow from one join, and
sums, regressions and medians take them as weights.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiospark.functions.numeric import ratio
from ratiospark.operators.positions import with_position
from ratiospark.operators.quantiles import quantiles
from ratiospark.sources.staging import staged

DRAW_SCHEMA = "bootstrap_id long, draw_no long, block_no long, take_n long"


def in_blocks(df: DataFrame, date: str, unit: str, key: Sequence[str]) -> DataFrame:
    """Adds ``block`` (calendar start) and ``pos_in_block`` (from 0)."""
    placed = with_position(df.withColumn("block", F.date_trunc(unit, date)), [date, *key], ["block"], "pos_in_block")
    return placed.withColumn("pos_in_block", F.col("pos_in_block") - 1)


def block_sizes(rows: DataFrame) -> list[tuple[object, int]]:
    """Blocks in order of time with their sizes; as many as calendar periods."""
    return [(r.block, r.n) for r in rows.groupBy("block").agg(F.count("*").alias("n")).orderBy("block").collect()]


def random_picker(seed: int, n_blocks: int) -> Callable[[int, int], int]:
    """Uniform draws from one generator, in order of call."""
    rng = np.random.default_rng(seed)
    return lambda bootstrap, draw: int(rng.integers(0, n_blocks))


def stepping_picker(n_blocks: int, one: int = 7919, two: int = 104729) -> Callable[[int, int], int]:
    """A fixed rule in place of chance: (one * bootstrap + two * draw) modulo the blocks."""
    return lambda bootstrap, draw: (one * bootstrap + two * draw) % n_blocks


def draws(sizes: Sequence[int], n_bootstrap: int, pick: Callable[[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(bootstrap_id, draw_no, block_no, take_n); a single block gives the sample itself."""
    total, out = sum(sizes), []
    for b in range(n_bootstrap):
        held = draw = 0
        while held < total:
            block = pick(b, draw)
            take = min(sizes[block], total - held)
            out.append((b, draw, block, take))
            held, draw = held + take, draw + 1
    return out


def multiplicity(spark: SparkSession, rows: DataFrame, blocks: Sequence[object], drawn: Sequence[tuple[int, int, int, int]]) -> DataFrame:
    """The rows of each resample once, with ``mult``: how often the block was drawn far enough.

    A place in its block tells a row from others, so its count follows from the
    block's draws alone, and no row is shuffled.
    """
    # Only the last draw of a resample is cut, so a block has few different lengths.
    takes: dict[tuple[int, int], list[int]] = {}
    for b, _, block, take in drawn:
        takes.setdefault((b, block), []).append(take)
    # Stretches of places that are drawn equally often.
    table = []
    for (b, block), lengths in takes.items():
        start = 0
        for end in sorted(set(lengths)):
            table.append((b, blocks[block], start, end, sum(n >= end for n in lengths)))
            start = end
    stretches = spark.createDataFrame(table, "bootstrap_id long, block timestamp, _from long, _to long, mult long")
    joined = rows.join(F.broadcast(stretches), "block").where("pos_in_block >= _from AND pos_in_block < _to")
    return joined.select("bootstrap_id", *rows.columns, "mult")


def weighted_study(resampled: DataFrame, av: str = "av", sp: str = "sp") -> DataFrame:
    """Ratio measures of each resample, each row counted ``mult`` times."""
    w, r = F.col("mult"), F.col(av) / F.col(sp)
    rows = resampled.withColumn("r", r)
    sums = {"n": F.sum("mult"), "mean_ratio": F.sum(w * F.col("r")) / F.sum(w), "wmean_ratio": ratio(F.sum(w * F.col(av)), F.sum(w * F.col(sp)))}
    first = staged(quantiles(rows, ["bootstrap_id"], {"median_ratio": (F.col("r"), 0.5)}, sums, weight=w).select("bootstrap_id", "n", "median_ratio", "mean_ratio", "wmean_ratio"))
    second = rows.join(F.broadcast(first.select("bootstrap_id", "median_ratio")), "bootstrap_id").groupBy("bootstrap_id").agg((100 * F.sum(w * F.abs(F.col("r") - F.col("median_ratio"))) / F.sum(w) / F.first("median_ratio")).alias("cod"))
    return first.join(second, "bootstrap_id").withColumn("prd", ratio("mean_ratio", "wmean_ratio"))


def mean_and_spread(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each measure over resamples, long."""
    long = metrics.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', cast({c} as double)" for c in columns) + ") as (metric, value)"))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
