"""Row positions in a total order, and what follows from them (windows W1-W6, splits, equal-count groups)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.operators.quantiles import IN_MEMORY, LARGE, SMALL, largest_group, same
from ratiospark.sources.staging import staged


def with_position(df: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), name: str = "pos", in_memory: int | None = None) -> DataFrame:
    """Adds the row's position, from 1, in its group, or in the whole table without groups.

    Groups of at most ``in_memory`` rows are ranked by a window in each.  Beyond,
    and for the whole table, rows are dealt out by ranges of group and order,
    sorted in each range and staged, so no task holds a group; a row's place in
    its range and the sizes of the ranges before give its position.
    """
    if groups and _small(df, groups, in_memory):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long"))
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    ranged = staged(ranged.withColumn("_row", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND(2**33 - 1)}).drop("_row")
    sizes = ranged.groupBy(*groups, "_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    # One row for each range that a group has.
    earlier = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("_part")
    before = sizes.select(*groups, "_part", (F.sum("_size").over(earlier) - F.col("_size") - F.col("_first") + 1).alias("_before"))
    placed = same(ranged, before, [*groups, "_part"], "inner")
    return placed.withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_part", "_at", "_before")


def _small(df: DataFrame, groups: Sequence[str], in_memory: int | None) -> bool:
    limit = IN_MEMORY if in_memory is None else in_memory
    return limit >= SMALL or (limit != LARGE and largest_group(df, groups) <= limit)


def with_running_sum(df: DataFrame, order: Sequence[Column | str], groups: Sequence[str], value: str, name: str = "before", in_memory: int | None = None) -> DataFrame:
    """Adds the sum of a whole-numbered ``value`` over the rows before in the group, 0 for the first: positions of rows that stand for several.

    As in ``with_position``, groups over ``in_memory`` rows are dealt out by ranges.
    """
    if _small(df, groups, in_memory):
        over = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(over), F.lit(0)).cast("long"))
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    ranged = staged(ranged.withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    sizes = ranged.groupBy(*groups, "_part").agg(F.sum(value).alias("_size"))
    earlier = Window.partitionBy(*groups).orderBy("_part")
    before = sizes.select(*groups, "_part", (F.sum("_size").over(earlier) - F.col("_size")).alias("_before"))
    here = Window.partitionBy(*groups, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = same(ranged.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0))), before, [*groups, "_part"], "inner")
    return placed.withColumn(name, (F.col("_here") + F.col("_before")).cast("long")).drop("_part", "_row", "_here", "_before")


def equal_count_group(pos: Column, n: Column, k: Column | int) -> Column:
    """Group (from 0) of a position among n rows dealt in order to k groups; the first n mod k have one more."""
    k = F.lit(k) if isinstance(k, int) else k
    small, extra = F.floor(n / k), n % k
    in_large = pos <= (small + 1) * extra
    return F.when(in_large, F.floor((pos - 1) / (small + 1))).otherwise(extra + F.floor((pos - 1 - (small + 1) * extra) / F.greatest(small, F.lit(1)))).cast("int")


def average_rank(c: str, groups: Sequence[str]) -> Column:
    """Rank of a value in its group, ties sharing the mean of their places, over the group's rows; for small groups."""
    if not groups:
        raise ValueError("without groups, take with_average_rank")
    place = F.rank().over(Window.partitionBy(*groups).orderBy(c)) + (F.count("*").over(Window.partitionBy(*groups, c)) - 1) / 2
    return place / F.count("*").over(Window.partitionBy(*groups))


def with_average_rank(df: DataFrame, c: str, name: str) -> DataFrame:
    """W4 over the whole table, from positions by ranges; rows with a NULL value are left out."""
    rows = df.where(F.col(c).isNotNull())
    n = rows.count()
    ranks = with_position(rows.select(c), [c], name="_pos").groupBy(c).agg((F.avg("_pos") / n).alias(name))
    return rows.join(ranks, c)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def exact_sample(df: DataFrame, fraction: float, key: Sequence[str], seed: int) -> DataFrame:
    """int(fraction * n) rows, those with the least MD5 of key and seed, without replacement; rows that share a key follow by it alone.

    The hashes' first 16 bits are counted; all rows under the range in which the
    last row falls are taken, and only that range is sorted.
    """
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be in (0, 1]")
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(str(seed)))))
    ranges = sorted(hashed.groupBy(F.left("_h", F.lit(4)).alias("h")).agg(F.count("*").alias("n")).collect())
    left = int(fraction * sum(r.n for r in ranges))
    for h, n in ranges:
        if n > left:
            break
        left -= n
    else:
        return df
    whole = hashed.where(F.left("_h", F.lit(4)) < h)
    edge = hashed.where(F.left("_h", F.lit(4)) == h).orderBy("_h", *key).limit(left)
    return whole.unionByName(edge).drop("_h")
