"""Exact quantiles by group that no task holds a group for.

``percentile`` keeps all distinct values of a group in one task.  That is the
quickest way while groups are small, so it is taken up to ``IN_MEMORY`` rows a group.
Beyond, values are counted in intervals, first by their logarithm, then in equal
parts of the interval that holds the wanted rank, until it has few enough rows to be
ranked by value.  Each pass is one aggregate that combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.sources.staging import staged, unstaged

#: Rows of a group up to which one task ranks it.
IN_MEMORY = 2_000_000
#: Passed as ``in_memory``: the groups are known to be small, so they need no count.
SMALL = 1 << 62
#: Passed as ``in_memory``: some are known to be large.
LARGE = 0
#: Rows of an interval up to which they are ranked one by one.
OPEN = 200_000
CELLS = 65_536


def largest_group(df: DataFrame, groups: Sequence[str]) -> int:
    """Rows of the largest group."""
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")) if groups else df.agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def same(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Joins by group, NULL being a group like others."""
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & left[n].eqNullSafe(renamed[f"_r_{n}"])
    return left.join(renamed, condition, how).drop(*(f"_r_{n}" for n in names))


def how_large(df: DataFrame, groups: Sequence[str], in_memory: int | None = None) -> int:
    """What to pass on as ``in_memory`` to several operators over the same rows and groups, so that these are counted once: ``SMALL`` or ``LARGE``."""
    return SMALL if largest_group(df, groups) <= (IN_MEMORY if in_memory is None else in_memory) else LARGE


def quantiles(df: DataFrame, groups: Sequence[str], wanted: Mapping[str, tuple[Column, float]], others: Mapping[str, Column] | None = None, in_memory: int | None = None, weight: Column | None = None) -> DataFrame:
    """One row per group (one in all without groups): the exact, linearly interpolated quantiles ``wanted`` as name: (value, share), and other aggregates.

    NULL and NaN are no values; a group without values has NULL.  ``weight`` (a
    whole number) counts a row so many times.  Quantiles of one value share a buffer.
    """
    others = dict(others or {})
    clean = lambda v: F.when(~F.isnan(v.cast("double")), v.cast("double"))
    values: dict[str, tuple[Column, list[str]]] = {}
    for k, (v, _) in wanted.items():
        values.setdefault(str(v), (v, []))[1].append(k)
    limit = max(1, IN_MEMORY // max(1, len(values))) if in_memory is None else in_memory
    if not wanted or limit >= SMALL or (limit != LARGE and largest_group(df, groups) <= limit):
        often = [] if weight is None else [weight]
        arrays = [F.percentile(clean(v), F.array(*(F.lit(float(wanted[k][1])) for k in names)), *often).alias(f"_values_{i}") for i, (v, names) in enumerate(values.values())]
        aggs = [*arrays, *(v.alias(k) for k, v in others.items())]
        out = df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)
        place = {k: (i, j) for i, (_, names) in enumerate(values.values()) for j, k in enumerate(names)}
        return out.select(*groups, *(F.col(f"_values_{place[k][0]}")[place[k][1]].alias(k) for k in wanted), *others)
    found = _by_intervals(df, groups, {k: (clean(v), q) for k, (v, q) in wanted.items()}, limit, F.lit(1) if weight is None else weight)
    counted = [F.count(F.lit(1)).alias("_n"), *(v.alias(k) for k, v in others.items())]
    base = df.groupBy(*groups).agg(*counted) if groups else df.agg(*counted)
    out = same(base, found, groups) if groups else base.crossJoin(F.broadcast(found))
    return out.select(*groups, *wanted, *others)


def _by_intervals(df: DataFrame, groups: Sequence[str], wanted: Mapping[str, tuple[Column, float]], limit: int, weight: Column) -> DataFrame:
    # Quantiles of one column share its passes.
    columns: dict[str, tuple[int, Column]] = {}
    for value, _ in wanted.values():
        columns.setdefault(str(value), (len(columns), value))
    asked = [(columns[str(v)][0], lambda total, q=q: F.lit(float(q)) * (total - 1)) for v, q in wanted.values()]
    every = ranked_values(df, groups, [v for _, v in columns.values()], asked, weight, limit)
    low = lambda k: F.min(F.when((F.col("out") == k) & (F.col("rank") == F.floor("place")), F.col("value")))
    high = lambda k: F.min(F.when((F.col("out") == k) & (F.col("rank") == F.ceil("place")), F.col("value")))
    share = lambda k: F.min(F.when(F.col("out") == k, F.col("place") - F.floor("place")))
    out = staged(every.groupBy("group").agg(*((low(k) + share(k) * (high(k) - low(k))).alias(name) for k, name in enumerate(wanted))))
    return out.select(*(F.col(f"group.g{i}").alias(g) for i, g in enumerate(groups)), *wanted)


def ranked_values(df: DataFrame, groups: Sequence[str], values: Sequence[Column], asked: Sequence[tuple[int, Callable[[Column], Column]]], weight: Column, limit: int = LARGE) -> DataFrame:
    """The values at the places asked for, as (group, out, place, rank, value, before), one row each for the ranks around a place.

    ``asked`` has the number of a value and its place (from 0) given the sum of
    weights in the group; none where that is NULL.  ``before`` is the sum of
    weights of lesser values.
    """
    limit = min(limit, OPEN) if limit != LARGE else OPEN
    group = F.struct(*(F.col(g).alias(f"g{i}") for i, g in enumerate(groups))) if groups else F.struct(F.lit(0).alias("g"))
    columns = F.inline(F.array(*(F.struct(F.lit(c).alias("which"), v.alias("value")) for c, v in enumerate(values))))
    # log1p and floor rise with the size of a value, so the intervals are in its order.
    interval = (F.signum("value") * F.floor(F.log1p(F.abs("value") * 1e6) * 2048)).cast("long")
    long = df.select(group.alias("group"), weight.cast("long").alias("w"), columns).where("value IS NOT NULL").withColumn("cell", interval)
    counted = staged(long.groupBy("group", "which", "cell").agg(F.sum("w").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    whole, rising = Window.partitionBy("group", "which"), Window.partitionBy("group", "which").orderBy("cell")
    placed = counted.withColumns({"total": F.sum("n").over(whole), "before": F.sum("n").over(rising) - F.col("n")})
    places = F.array(*(F.struct(F.lit(k).alias("out"), F.lit(c).alias("of"), place(F.col("total")).alias("place")) for k, (c, place) in enumerate(asked)))
    ranks = placed.withColumn("asked", F.explode(F.filter(places, lambda a: (a["of"] == F.col("which")) & a["place"].isNotNull()))).withColumn("place", F.col("asked.place").cast("double"))
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))))
    live = staged(ranks.where("rank >= before AND rank < before + n").select("group", "which", F.col("asked.out").alias("out"), "place", "rank", "before", "n", "lo", "hi"))
    unstaged(counted)
    done = [live.where("lo = hi").select("group", "out", "place", "rank", F.col("lo").alias("value"), "before")]
    open_ = live.where("lo < hi")
    inside = lambda rows: long.drop("cell").join(rows.select("group", "which", "lo", "hi").distinct(), ["group", "which"]).where("value BETWEEN lo AND hi")
    while (open_.agg(F.max("n")).first()[0] or 0) > max(1, limit):
        part = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))
        cells = inside(open_).withColumn("part", part).groupBy("group", "which", "lo", "part").agg(F.sum("w").alias("m"), F.min("value").alias("new_lo"), F.max("value").alias("new_hi"))
        cells = cells.withColumn("under", F.sum("m").over(Window.partitionBy("group", "which", "lo").orderBy("part")) - F.col("m"))
        next_ = open_.join(cells, ["group", "which", "lo"]).where("rank >= before + under AND rank < before + under + m")
        open_ = staged(next_.select("group", "which", "out", "place", "rank", (F.col("before") + F.col("under")).alias("before"), F.col("m").alias("n"), F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi")))
        done.append(open_.where("lo = hi").select("group", "out", "place", "rank", F.col("lo").alias("value"), "before"))
        open_ = open_.where("lo < hi")
    ranked = inside(open_).groupBy("group", "which", "lo", "value").agg(F.sum("w").alias("m"))
    ranked = ranked.withColumn("under", F.sum("m").over(Window.partitionBy("group", "which", "lo").orderBy("value")) - F.col("m"))
    last = open_.join(ranked, ["group", "which", "lo"]).where("rank >= before + under AND rank < before + under + m")
    every = last.select("group", "out", "place", "rank", "value", (F.col("before") + F.col("under")).alias("before"))
    for x in done:
        every = every.unionByName(x)
    return every
