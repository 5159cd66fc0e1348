"""Accuracy, uniformity and vertical equity of assessed values (av) against prices (sp), by group.

A study takes two passes: sums, moments and the exact median of the ratio av / sp
by group; then what needs that median, joined back by group.  Quantiles and
positions are exact at any size of a group; see ``quantiles`` and ``positions``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.functions.numeric import EPS, finite, fisher_z, pearson, positive, r_squared, ratio, slope
from ratiospark.operators.positions import equal_count_group, with_position, with_running_sum
from ratiospark.operators.quantiles import IN_MEMORY, SMALL, how_large, quantiles, ranked_values, same
from ratiospark.sources.staging import staged

ALL = "_all"


def usable(df: DataFrame, groups: Sequence[str], av: str, sp: str, keys: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Rows with finite positive values as (groups, av, sp, r, keys); a table without groups is one group."""
    rows = df if groups else df.withColumn(ALL, F.lit(0))
    names = list(groups) or [ALL]
    picked = rows.select(*names, F.col(av).cast("double").alias("av"), F.col(sp).cast("double").alias("sp"), *(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)))
    return picked.where(positive("av") & positive("sp")).withColumn("r", F.col("av") / F.col("sp")), names


def quantile_columns(t: str = "sp", p: str = "av", r: str = "r") -> dict[str, tuple[Column, float]]:
    """Values and shares of the quantiles among the measures."""
    off = lambda d: 100 * F.abs(d)
    out = {"mdape_pred": (off(ratio(t, p) - 1), 0.5), "mdape_actual": (off(ratio(F.col(p) - F.col(t), t)), 0.5), "median_ratio": (F.col(r), 0.5), "_q1": (F.col(r), 0.25), "_q3": (F.col(r), 0.75)}
    for q in (0.05, 0.5, 0.95):
        out[f"y_q{round(100 * q):02d}"] = (F.col(t), q)
        out[f"r_q{round(100 * q):02d}"] = (F.col(r), q)
    return out


def accuracy_columns(t: str = "sp", p: str = "av", r: str = "r") -> dict[str, Column]:
    """One-pass measures of predictions p of t that are no quantiles."""
    t_, p_, r_ = F.col(t), F.col(p), F.col(r)
    error, log_error = p_ - t_, F.log(p_) - F.log(t_)
    out = {
        "n": F.count("*"),
        "r2": r_squared(t, p),
        "r2_log": r_squared(F.log(t_), F.log(p_)),
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "mape": F.avg(F.abs(error) / F.greatest(F.abs(t_), F.lit(EPS))),
        "bias": F.avg(error),
        "corr_r_price": pearson(r, t),
        "corr_r_logprice": pearson(r_, F.log(t_)),
        "slope_r_logy": slope(r_, F.log(t_)),
        "slope_r_y": slope(r, t),
        "var_ratio": F.var_pop(r_),
        "var_y": F.var_pop(t_),
        "mean_ratio": F.avg(r_),
        "wmean_ratio": ratio(F.sum(p_), F.sum(t_)),
        "cov_iaao": ratio(F.stddev_samp(r_), F.avg(r_)),
        "prd": ratio(F.avg(r_), ratio(F.sum(p_), F.sum(t_))),
        "sd_ratio": F.coalesce(F.stddev_samp(r_), F.lit(0.0)),
        "mae_log": F.avg(F.abs(log_error)),
        "rmse_log": F.sqrt(F.avg(log_error * log_error)),
        "bias_log": F.avg(log_error),
        "sd_log": F.stddev_samp(log_error),
        "mean_price": F.avg(t_),
        "small_share": F.avg((F.abs(t_) <= 10 * EPS).cast("int")),
    }
    out["fisher_z_r_y"] = fisher_z(pearson(r, t))
    return out


def accuracy(df: DataFrame, groups: Sequence[str] = (), av: str = "av", sp: str = "sp", only: Sequence[str] | None = None) -> DataFrame:
    """The one-pass measures by group, all or those named."""
    rows, names = usable(df, groups, av, sp)
    chosen = {k: v for k, v in accuracy_columns().items() if only is None or k in only}
    spread = only is None or "iqr_ratio" in only
    asked = {k: v for k, v in quantile_columns().items() if only is None or k in only or (spread and k in ("_q1", "_q3"))}
    out = quantiles(rows, names, asked, chosen)
    if spread:
        out = out.withColumn("iqr_ratio", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")
    return out if groups else out.drop(ALL)


def oos_r2(df: DataFrame, groups: Sequence[str], train_mean: Column, av: str = "av", sp: str = "sp") -> DataFrame:
    """A2: 1 - MSE(t, p) / MSE(t, mean of the training targets), 0 where the baseline has no error.

    ``train_mean`` on the scale of the prices; the older form with a mean of logs
    against prices is had by passing that mean.
    """
    rows, names = usable(df.withColumn("_base", train_mean), [*groups, "_base"], av, sp)
    names = list(groups) or [ALL]
    rows = rows if groups else rows.withColumn(ALL, F.lit(0))
    base = F.avg(F.pow(F.col("sp") - F.col("_base"), 2))
    out = rows.groupBy(*names).agg(F.when(base == 0, F.lit(0.0)).otherwise(1 - ratio(F.avg(F.pow(F.col("sp") - F.col("av"), 2)), base)).alias("oos_r2"))
    return out if groups else out.drop(ALL)


def _with_median(rows: DataFrame, names: list[str], size: int | None = None) -> DataFrame:
    """Rows with their group's size and median ratio; large groups are read several times, so their rows are staged unless their ``size`` is told."""
    if size is None:
        size = how_large(rows, names)
        rows = rows if size >= SMALL else _staged(rows)
    told = quantiles(rows, names, {"m": (F.col("r"), 0.5)}, {"n": F.count("*")}, size)
    # A table of known, small size is broadcast; an aggregate would have the rows gathered by group.
    return same(rows, told if size >= SMALL else staged(told), names, "inner")


def _cod() -> Column:
    return ratio(100 * F.avg(F.abs(F.col("r") - F.col("m"))), F.first("m"))


def _prb(least: int = 2) -> Column:
    x = F.log2(0.5 * (F.col("av") / F.col("m") + F.col("sp")))
    return F.when(F.count("*") >= least, slope((F.col("r") - F.col("m")) / F.col("m"), x))


def cod(df: DataFrame, groups: Sequence[str] = (), av: str = "av", sp: str = "sp") -> DataFrame:
    """Mean absolute deviation from the median ratio, in percent of it."""
    rows, names = usable(df, groups, av, sp)
    out = _with_median(rows, names).groupBy(*names).agg(_cod().alias("cod"))
    return out if groups else out.drop(ALL)


def prb(df: DataFrame, groups: Sequence[str] = (), av: str = "av", sp: str = "sp", least: int = 2) -> DataFrame:
    """Slope of (r - m) / m on log2 of the mean of av / m and sp; NULL under ``least`` rows (3 in the stricter rule)."""
    rows, names = usable(df, groups, av, sp)
    out = _with_median(rows, names).groupBy(*names).agg(_prb(least).alias("prb"))
    return out if groups else out.drop(ALL)


def vei_groups(n: Column) -> Column:
    """Number of equal-count groups for n rows; NULL under 20."""
    return F.when(n < 20, None).when(n <= 50, 2).when(n <= 500, 4).otherwise(10)


def vei_profile(df: DataFrame, groups: Sequence[str] = (), av: str = "av", sp: str = "sp", keys: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """Median ratio and size of each group of rising value (the mean of sp and av / m)."""
    rows, names = usable(df, groups, av, sp, keys)
    rows = _staged(rows)
    size = how_large(rows, names)
    out = _profile(_with_median(rows, names, size), names, k, size)
    return out if groups else out.drop(ALL)


def _staged(rows: DataFrame) -> DataFrame:
    """Usable rows staged without their ratio, which is made anew from them."""
    return staged(rows.drop("r")).withColumn("r", F.col("av") / F.col("sp"))


def _profile(rows: DataFrame, names: Sequence[str], k: int | None, size: int, weight: str | None = None, ends: bool = False) -> DataFrame:
    """Median ratio and size of the strata of rows that know their group's ``m`` and ``n``; each counts ``weight`` times, and its copies may fall into two strata.

    With ``ends`` only the first and the last stratum are made: the rows between
    them are dropped as soon as the two values that end them are known.

    Rows of large groups are not put in order: the strata end at up to nine places
    of a group, whose values are found by counting.  Only rows with such a value
    are placed one by one, the others follow from it.
    """
    w = F.col(weight) if weight else F.lit(1)
    rows = rows.withColumn("proxy", 0.5 * F.col("sp") + 0.5 * F.col("av") / F.col("m")).withColumn("_w", w.cast("long"))
    strata = lambda n: F.lit(k) if k else vei_groups(n)
    start = lambda s, n: s * F.floor(n / strata(n)) + F.least(s, n % strata(n))
    order = ["proxy", *(c for c in rows.columns if c.startswith("key_")), "sp", "av"]

    def dealt(placed: DataFrame) -> DataFrame:
        """A row for each stratum that copies of a row fall into, from their place in the group."""
        group = lambda pos: equal_count_group(pos, F.col("n"), F.col("k"))
        placed = placed.withColumn("stratum", F.explode(F.sequence(group(F.col("before") + 1), group(F.col("before") + F.col("_w")))) if weight else group(F.col("before") + 1))
        return placed.withColumn("copies", F.least(F.col("before") + F.col("_w"), start(F.col("stratum") + 1, F.col("n"))) - F.greatest(F.col("before"), start(F.col("stratum"), F.col("n"))) if weight else F.lit(1))

    rows = rows.withColumn("k", strata(F.col("n"))).where("k IS NOT NULL")
    is_asked = (F.col("stratum") == 0) | (F.col("stratum") == F.col("k") - 1) if ends else F.lit(True)
    if size >= SMALL:
        cut = dealt(with_running_sum(rows, order, names, "_w", in_memory=size)).where(is_asked)
    else:
        later = [lambda n: F.lit(1), lambda n: strata(n) - 1] if ends else [lambda n, s=s: F.lit(s) for s in range(1, k or 10)]
        asked = [(0, lambda n, s=s: F.when((strata(n) > s(n)) & (start(s(n), n) > 0), start(s(n), n) - 1)) for s in later]
        found = ranked_values(rows, names, [F.col("proxy")], asked, F.col("_w"))
        cuts = staged(found.select(*(F.col(f"group.g{i}").alias(g) for i, g in enumerate(names)), "out", "value", F.col("before").alias("_under")))
        row = cuts.groupBy(*names).agg(*(F.min(F.when(F.col("out") == i, F.col("value"))).alias(f"_cut_{i}") for i in range(len(asked))))
        marked = same(rows, staged(row), names, "left")
        on = lambda i: F.coalesce(F.col("proxy") == F.col(f"_cut_{i}"), F.lit(False))
        above = lambda i: F.coalesce((F.col("proxy") > F.col(f"_cut_{i}")).cast("int"), F.lit(0))
        tied, stratum = F.lit(False), F.lit(0)
        for i in range(len(asked)):
            tied, stratum = tied | on(i), stratum + above(i)
        if ends:
            stratum = F.when(F.col("proxy") < F.col("_cut_0"), 0).when(above(1) == 1, F.col("k") - 1)
        free = marked.where(~tied).withColumn("stratum", stratum).where("stratum IS NOT NULL").withColumn("copies", F.col("_w"))
        ties = staged(marked.where(tied).drop(*(f"_cut_{i}" for i in range(len(asked)))))
        under = cuts.groupBy(*names, F.col("value").alias("proxy")).agg(F.first("_under").alias("_under"))
        placed = with_running_sum(ties, order[1:], [*names, "proxy"], "_w", "_ahead")
        placed = same(placed, staged(under), [*names, "proxy"], "inner").withColumn("before", F.col("_under") + F.col("_ahead"))
        slim = [*names, "stratum", "r", "copies", "m", "k"]
        cut = free.select(slim).unionByName(staged(dealt(placed).where(is_asked).select(slim)))
    often = F.col("copies")
    return quantiles(cut, [*names, "stratum"], {"median_ratio": (F.col("r"), 0.5)}, {"count": F.sum("copies"), "m": F.first("m"), "k": F.first("k")}, size, often if weight or size < SMALL else None)


def vei(df: DataFrame, groups: Sequence[str] = (), av: str = "av", sp: str = "sp", keys: Sequence[str] = (), k: int | None = None, rule: str = "ends") -> DataFrame:
    """100 * (median ratio of the last group - of the first) / m.

    NULL under 20 rows or where a group has under 10: the first or last by rule
    "ends", any by rule "all".
    """
    names = list(groups) or [ALL]
    profile = vei_profile(df if groups else df.withColumn(ALL, F.lit(0)), names, av, sp, keys, k)
    out = _ends(profile, names, rule)
    return out if groups else out.drop(ALL)


def _ends(profile: DataFrame, names: Sequence[str], rule: str) -> DataFrame:
    is_end = (F.col("stratum") == 0) | (F.col("stratum") == F.col("k") - 1)
    low = F.min(F.when(is_end, F.col("count")) if rule == "ends" else F.col("count"))
    ends = F.max(F.when(F.col("stratum") == F.col("k") - 1, F.col("median_ratio"))) - F.max(F.when(F.col("stratum") == 0, F.col("median_ratio")))
    return profile.groupBy(*names).agg(F.when(low >= 10, 100 * ends / F.first("m")).alias("vei"), F.transform(F.sort_array(F.collect_list(F.struct("stratum", "median_ratio"))), lambda x: x["median_ratio"]).alias("vei_medians"), F.transform(F.sort_array(F.collect_list(F.struct("stratum", "count"))), lambda x: x["count"]).alias("vei_counts"))


def gini(df: DataFrame, groups: Sequence[str] = (), av: str = "av", sp: str = "sp") -> DataFrame:
    """Concentration of av and of sp in the order of sp (ties by falling av), KI and MKI."""
    rows, names = usable(df, groups, av, sp)
    size = how_large(rows, names)
    out = _gini(rows if size >= SMALL else _staged(rows), names, size)
    return out if groups else out.drop(ALL)


def _gini(rows: DataFrame, names: Sequence[str], size: int, weight: str | None = None) -> DataFrame:
    """Ginis, each row counting ``weight`` times.

    Large groups are cut into intervals of sp, whose sums need places in the
    interval only: one shuffle of prices.  An interval that is itself large (one
    price for very many rows) is placed by ranges.
    """
    # Without weights the rows that are shuffled have none, and a row's place is its number.
    rows = rows.select(*names, "av", "sp", *([F.col(weight).cast("long").alias("_w")] if weight else []))
    held = F.sum("_w") if weight else F.count("*")
    if size >= SMALL:
        rows, by, cells, limit = rows.withColumn("_cell", F.lit(0)), list(names), None, size
    else:
        rows, by = rows.withColumn("_cell", F.floor(F.log1p(F.col("sp") * 1e6) * 2048)), [*names, "_cell"]
        cells = staged(rows.groupBy(*by).agg(held.alias("_n"), F.count("*").alias("_rows")))
        limit = SMALL if (cells.agg(F.max("_rows")).first()[0] or 0) <= IN_MEMORY else size
    order = ["sp", F.desc("av")]
    if weight:
        placed, value = with_running_sum(rows, order, by, "_w", "_ahead", in_memory=limit), lambda x: F.col("_w") * F.col(x)
        places = F.col("_w") * F.col("_ahead") + F.col("_w") * (F.col("_w") + 1) / 2
    else:
        placed, value, places = with_position(rows, order, by, "_place", in_memory=limit), F.col, F.col("_place")
    sums = placed.groupBy(*names, "_cell").agg(held.alias("_n"), *(a for x in ("av", "sp") for a in (F.sum(F.col(x) * places).alias(f"_p_{x}"), F.sum(value(x)).alias(f"_s_{x}"))))
    if cells is not None:
        earlier = Window.partitionBy(*names).orderBy("_cell")
        before = cells.select(*by, (F.sum("_n").over(earlier) - F.col("_n")).alias("_under"))
        sums = same(sums, before, by, "inner")
    else:
        sums = sums.withColumn("_under", F.lit(0))
    n = F.sum("_n")
    index = lambda x: (2 * ratio(F.sum(F.col(f"_p_{x}") + F.col("_under") * F.col(f"_s_{x}")), F.sum(f"_s_{x}")) - (n + 1)) / n
    return _concentration(sums.groupBy(*names).agg(index("av").alias("gini_av"), index("sp").alias("gini_sp")))


def _concentration(ginis: DataFrame) -> DataFrame:
    return ginis.withColumns({"ki": F.col("gini_av") - F.col("gini_sp"), "mki": ratio("gini_av", "gini_sp")})


def bundle(df: DataFrame, groups: Sequence[str], av: str = "av", sp: str = "sp", keys: Sequence[str] = (), only: Sequence[str] | None = None, held: bool = False) -> DataFrame:
    """Every measure by group, or those named and n, one row each.

    The rows are made and their groups counted once; the median, which the other
    parts need, comes from the first aggregate.  Parts of which no measure is named
    are not made.  Rows that are ``held``, which means staged and cheap to read
    again, are not staged a second time.
    """
    asked = lambda *measures: only is None or any(x in only for x in measures)
    vertical = asked("vei")
    rows, names = usable(df, groups, av, sp, keys if vertical else ())
    rows = rows if held else _staged(rows)
    size = how_large(rows, names)
    spread = asked("iqr_ratio")
    wanted = {k: v for k, v in quantile_columns().items() if asked(k) or k == "median_ratio" or (spread and k in ("_q1", "_q3"))}
    first = staged(quantiles(rows, names, wanted, {k: v for k, v in accuracy_columns().items() if asked(k) or k == "n"}, size))
    rows = same(rows, first.select(*names, F.col("median_ratio").alias("m"), "n"), names, "inner")
    parts = []
    if asked("cod", "prb"):
        parts.append(rows.groupBy(*names).agg(_cod().alias("cod"), _prb().alias("prb")))
    if vertical:
        parts.append(_ends(_profile(rows, names, None, size, None, True), names, "ends").select(*names, "vei"))
    if asked("gini_av", "gini_sp", "ki", "mki"):
        parts.append(_gini(rows, names, size))
    out = first.withColumn("iqr_ratio", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3") if spread else first
    for part in parts:
        out = same(out, part, names)
    if only is not None:
        out = out.select(*names, "n", *(c for c in only if c != "n"))
    return out if groups else out.drop(ALL)


def weighted_bundle(df: DataFrame, groups: Sequence[str], weight: str, av: str = "av", sp: str = "sp", keys: Sequence[str] = ()) -> DataFrame:
    """The measures of ``bundle`` where each row counts ``weight`` (a whole number) times, no row copied.

    Means come first, then moments about them.  Positions are running sums of the
    weights; a row whose copies fall into two groups of the VEI counts in both.
    """
    rows, names = usable(df, groups, av, sp, [weight, *keys])
    rows = _staged(rows.withColumnRenamed("key_0", "w").where("w > 0"))
    size, w, n = how_large(rows, names), F.col("w"), F.sum("w")
    t, p, r = F.col("sp"), F.col("av"), F.col("r")
    mean = lambda x: F.sum(w * x) / F.sum("w")
    log_error = F.log(p) - F.log(t)
    sums = {
        "n": n.cast("long"),
        "rmse": F.sqrt(mean(F.pow(p - t, 2))),
        "mae": mean(F.abs(p - t)),
        "mape": mean(F.abs(p - t) / F.greatest(F.abs(t), F.lit(EPS))),
        "bias": mean(p - t),
        "mean_ratio": mean(r),
        "wmean_ratio": ratio(F.sum(w * p), F.sum(w * t)),
        "mae_log": mean(F.abs(log_error)),
        "rmse_log": F.sqrt(mean(log_error * log_error)),
        "bias_log": mean(log_error),
        "mean_price": mean(t),
        "small_share": mean((F.abs(t) <= 10 * EPS).cast("int")),
        "_mean_log": mean(F.log(t)),
        "_flat_t": F.min(t) == F.max(t),
        "_flat_r": F.min(r) == F.max(r),
    }
    first = staged(quantiles(rows, names, quantile_columns(), sums, size, w))
    told = first.select(*names, F.col("median_ratio").alias("m"), "n", F.col("mean_price").alias("_t"), F.col("mean_ratio").alias("_r"), "_mean_log", "bias_log")
    rows = same(rows, told, names, "inner")
    dt, dr, dl, de = t - F.col("_t"), r - F.col("_r"), F.log(t) - F.col("_mean_log"), log_error - F.col("bias_log")
    x, y = F.log2(0.5 * (p / F.col("m") + t)), (r - F.col("m")) / F.col("m")
    moments = {"tt": dt * dt, "rr": dr * dr, "ll": dl * dl, "rt": dr * dt, "rl": dr * dl, "ee": de * de, "e2": F.pow(p - t, 2), "l2": F.pow(log_error, 2), "x": x, "y": y, "xx": x * x, "xy": x * y, "off": F.abs(r - F.col("m"))}
    about = rows.groupBy(*names).agg(*(F.sum(w * v).alias(f"_{k}") for k, v in moments.items()), (F.min(x) == F.max(x)).alias("_flat_x"))
    out = same(first, about, names)
    c = lambda k: F.col(f"_{k}")
    varied = lambda flat, v: F.when(~c(flat), v)
    sample = lambda v: F.when(F.col("n") > 1, F.sqrt(v / (F.col("n") - 1)))
    corr = lambda a, b, ab: varied("flat_t", varied("flat_r", c(ab) / F.sqrt(c(a) * c(b))))
    out = out.withColumns({
        "r2": varied("flat_t", 1 - c("e2") / c("tt")),
        "r2_log": varied("flat_t", 1 - c("l2") / c("ll")),
        "corr_r_price": corr("rr", "tt", "rt"),
        "corr_r_logprice": corr("rr", "ll", "rl"),
        "slope_r_logy": varied("flat_t", c("rl") / c("ll")),
        "slope_r_y": varied("flat_t", c("rt") / c("tt")),
        "var_ratio": c("rr") / F.col("n"),
        "var_y": c("tt") / F.col("n"),
        "cov_iaao": ratio(sample(c("rr")), "mean_ratio"),
        "sd_ratio": F.coalesce(sample(c("rr")), F.lit(0.0)),
        "sd_log": sample(c("ee")),
        "prd": ratio("mean_ratio", "wmean_ratio"),
        "cod": ratio(100 * c("off") / F.col("n"), "median_ratio"),
        "prb": F.when(F.col("n") >= 2, varied("flat_x", (c("xy") - c("x") * c("y") / F.col("n")) / (c("xx") - c("x") * c("x") / F.col("n")))),
        "iqr_ratio": F.col("_q3") - F.col("_q1"),
    }).withColumn("fisher_z_r_y", fisher_z(F.col("corr_r_price")))
    out = out.drop(*(k for k in out.columns if k.startswith("_") and k not in names))
    profile, ginis = _profile(rows, names, None, size, "w", True), _gini(rows, names, size, "w")
    for part in (_ends(profile, names, "ends").select(*names, "vei"), ginis):
        out = same(out, part, names)
    return out if groups else out.drop(ALL)


def ratio_mode(df: DataFrame, groups: Sequence[str], mode: str = "div", av: str = "av", sp: str = "sp") -> DataFrame:
    """Extended fairness columns with r = av / sp ("div") or ln av - ln sp ("diff"), against ln sp as y."""
    rows, names = usable(df, groups, av, sp)
    r = F.col("r") if mode == "div" else F.log("av") - F.log("sp")
    rows = rows.withColumn("q", r).withColumn("y", F.log("sp"))
    out = rows.groupBy(*names).agg(F.lit(mode).alias("fairness_ratio_mode"), pearson("q", "sp").alias("corr_r_y_price"), fisher_z(pearson("q", "sp")).alias("fisher_z_r_y_price"), slope("q", "sp").alias("slope_r_y_price"), F.var_pop("q").alias("var_r"), F.var_pop("y").alias("var_y"), F.count("*").alias("val_rows"))
    return out if groups else out.drop(ALL)


def quantile_strata(df: DataFrame, bins: int, sp: str = "sp") -> DataFrame:
    """Adds ``stratum`` (from 1): right-closed bins at the exact quantiles of sp, equal edges merged."""
    edges = quantiles(df, (), {f"q{k}": (F.col(sp), k / bins) for k in range(1, bins)})
    edges = edges.select(F.array_distinct(F.array(*edges.columns)).alias("edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn("stratum", (F.size(F.filter("edges", lambda e: e < F.col(sp))) + 1).cast("int")).drop("edges")


def quantile_report(df: DataFrame, bins: int, av: str = "av", sp: str = "sp") -> DataFrame:
    """Count, range, errors and ratio measures of each stratum of sp."""
    rows = staged(quantile_strata(staged(df.where(positive(av) & positive(sp)).select(av, sp)), bins, sp))
    sums = {"count": F.count("*"), "min_price": F.min(sp), "max_price": F.max(sp), "mean_error": F.avg(F.col(av) - F.col(sp)), "mape_pct": 100 * F.avg(F.abs(F.col(av) - F.col(sp)) / F.col(sp)), "mean_ratio": F.avg("r"), "prd": ratio(F.avg("r"), ratio(F.sum(av), F.sum(sp)))}
    one = quantiles(rows.withColumn("r", F.col(av) / F.col(sp)), ["stratum"], {"median_ratio": (F.col("r"), 0.5)}, sums)
    return one.join(cod(rows, ["stratum"], av, sp), "stratum").join(prb(rows, ["stratum"], av, sp, least=3), "stratum")


def equal_width_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Adds ``bin`` (from 0): half-open intervals of equal width from the least value to the greatest plus 1e-6."""
    edges = df.where(finite(column)).agg(F.min(column).alias("lo"), (F.max(column) + 1e-6).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")).drop("lo", "hi")


def group_spread(df: DataFrame, group: str, truth: str, guess: str) -> DataFrame:
    """Greatest and least group error and the greatest difference between groups, for MAE and MSE."""
    per = df.groupBy(group).agg(F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"), F.avg(F.pow(F.col(truth) - F.col(guess), 2)).alias("mse"))
    return per.agg(F.max("mae").alias("max_mae"), (F.max("mae") - F.min("mae")).alias("spread_mae"), F.max("mse").alias("max_mse"), (F.max("mse") - F.min("mse")).alias("spread_mse"))


def nan_if_incomplete(value: Column, *inputs: str) -> Column:
    """P12 without dropping rows: the aggregate ``value`` is NULL if an input has a NaN or NULL."""
    bad = F.sum(F.when(~finite(inputs[0]) | (~finite(inputs[1]) if len(inputs) > 1 else F.lit(False)), 1).otherwise(0))
    return F.when(bad == 0, value)


def line_fit(df: DataFrame, groups: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line of y on x by group, NULL where x is constant."""
    a = slope(y, x)
    return df.groupBy(*groups).agg(a.alias("slope"), (F.avg(y) - a * F.avg(x)).alias("intercept"))
