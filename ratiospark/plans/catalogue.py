"""Queries that apply the operators to the given tables, each with its equivalent in DuckDB's SQL.

Values are rounded in both, since sums in another order differ in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiospark.functions.ids import stable_id_column
from ratiospark.functions.numeric import r_squared
from ratiospark.operators import bootstrap, boosting, bounded, dependence, features, flags, folds, leafwise, linear, ratio_study, stacking, summary
from ratiospark.operators.positions import average_rank, exact_sample, first_per_key, with_position
from ratiospark.plans.bindings import KEYS, RUNS, SALES, STUDY, global_mean, ordered, runs, sales, table
from ratiospark.sources.staging import staged
from ratiospark.sources.tables import union_ragged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


# Ratio studies.


@query(f"WITH {STUDY} SELECT flag, count(*) AS n, round(quantile_cont(r, 0.5), 6) AS median_ratio, round(avg(r), 6) AS mean_ratio, round(sum(av) / sum(sp), 6) AS wmean_ratio FROM st GROUP BY flag")
def ratio_basic(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("n", "median_ratio", "mean_ratio", "wmean_ratio")))


@query(f"WITH {STUDY} SELECT flag, round(100 * avg(abs(r - m)) / any_value(m), 6) AS cod FROM j GROUP BY flag")
def ratio_cod(spark, sf):
    return rounded(ratio_study.cod(sales(spark, sf), ["flag"]))


@query(f"WITH {STUDY} SELECT flag, brand, round(stddev_samp(r) / avg(r), 6) AS cov_iaao FROM st GROUP BY ALL")
def ratio_cov(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag", "brand"], only=("cov_iaao",)))


@query(f"WITH {STUDY} SELECT flag, brand, round(avg(r) / (sum(av) / sum(sp)), 6) AS prd FROM st GROUP BY ALL")
def ratio_prd(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag", "brand"], only=("prd",)))


@query(f"WITH {STUDY} SELECT flag, round(regr_slope((r - m) / m, log2(0.5 * (av / m + sp))), 6) AS prb FROM j GROUP BY flag")
def ratio_prb(spark, sf):
    return rounded(ratio_study.prb(sales(spark, sf), ["flag"]))


_BY_BRAND = STUDY.replace("GROUP BY flag", "GROUP BY brand, flag").replace("SELECT flag, count(*)", "SELECT brand, flag, count(*)").replace("USING (flag)", "USING (brand, flag)")


@query(f"WITH {_BY_BRAND} SELECT brand, flag, round(CASE WHEN count(*) >= 3 THEN regr_slope((r - m) / m, log2(0.5 * (av / m + sp))) END, 6) AS prb FROM j GROUP BY ALL")
def ratio_prb_iaao(spark, sf):
    return rounded(ratio_study.prb(sales(spark, sf), ["brand", "flag"], least=3))


_VEI = """, cut AS (SELECT *, CASE WHEN n < 20 THEN NULL WHEN n <= 50 THEN 2 WHEN n <= 500 THEN 4 ELSE 10 END AS k,
        row_number() OVER (PARTITION BY flag ORDER BY proxy, k1, k2, k3, k4, sp, av) AS pos FROM j),
    strata AS (SELECT *, CASE WHEN pos <= (n // k + 1) * (n % k) THEN (pos - 1) // (n // k + 1) ELSE n % k + (pos - 1 - (n // k + 1) * (n % k)) // (n // k) END AS stratum FROM cut WHERE k IS NOT NULL),
    prof AS (SELECT flag, stratum::INTEGER AS stratum, count(*) AS count, quantile_cont(r, 0.5) AS median_ratio, any_value(m) AS m, any_value(k) AS k FROM strata GROUP BY flag, stratum)"""


@query(f"WITH {STUDY}{_VEI} SELECT flag, round(CASE WHEN min(CASE WHEN stratum IN (0, k - 1) THEN count END) >= 10 THEN 100 * (max(CASE WHEN stratum = k - 1 THEN median_ratio END) - max(CASE WHEN stratum = 0 THEN median_ratio END)) / any_value(m) END, 6) AS vei FROM prof GROUP BY flag")
def ratio_vei(spark, sf):
    return rounded(ratio_study.vei(sales(spark, sf), ["flag"], keys=KEYS).select("flag", "vei"))


@query(f"WITH {STUDY}{_VEI} SELECT flag, stratum, count, round(median_ratio, 6) AS median_ratio FROM prof")
def ratio_vei_profile(spark, sf):
    return rounded(ratio_study.vei_profile(sales(spark, sf), ["flag"], keys=KEYS).select("flag", "stratum", "count", "median_ratio"))


_VEI_BRAND = _VEI.replace("PARTITION BY flag", "PARTITION BY brand").replace("SELECT flag, stratum", "SELECT brand, stratum").replace("GROUP BY flag", "GROUP BY brand")
_STUDY_BRAND = STUDY.replace("SELECT flag, count(*)", "SELECT brand, count(*)").replace("GROUP BY flag", "GROUP BY brand").replace("USING (flag)", "USING (brand)")


@query(f"WITH {_STUDY_BRAND}{_VEI_BRAND} SELECT brand, round(CASE WHEN min(count) >= 10 THEN 100 * (max(CASE WHEN stratum = k - 1 THEN median_ratio END) - max(CASE WHEN stratum = 0 THEN median_ratio END)) / any_value(m) END, 6) AS vei, array_to_string(list(count ORDER BY stratum), ',') AS counts FROM prof GROUP BY brand")
def ratio_vei_report(spark, sf):
    out = ratio_study.vei(sales(spark, sf), ["brand"], keys=KEYS, rule="all")
    return rounded(out.select("brand", "vei", F.array_join("vei_counts", ",").alias("counts")))


_GINI = """, placed AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY sp, av DESC) AS pos FROM st),
    g AS (SELECT flag, (2 * sum(av * pos) / sum(av) - (count(*) + 1)) / count(*) AS gini_av, (2 * sum(sp * pos) / sum(sp) - (count(*) + 1)) / count(*) AS gini_sp FROM placed GROUP BY flag)"""


@query(f"WITH {STUDY}{_GINI} SELECT flag, round(gini_av, 6) AS gini_av, round(gini_sp, 6) AS gini_sp, round(gini_av / gini_sp, 6) AS mki FROM g")
def ratio_gini_mki(spark, sf):
    return rounded(ratio_study.gini(sales(spark, sf), ["flag"]).drop("ki"))


@query(f"WITH {STUDY}{_GINI} SELECT flag, round(gini_av - gini_sp, 6) AS ki FROM g")
def ratio_ki(spark, sf):
    return rounded(ratio_study.gini(sales(spark, sf), ["flag"]).select("flag", "ki"))


@query(f"WITH {STUDY} SELECT flag, " + ", ".join(f"round(quantile_cont({c}, {q / 100}), {d}) AS {n}_q{q:02d}" for c, n, d in (("sp", "y", 4), ("r", "r", 4)) for q in (5, 50, 95)) + " FROM st GROUP BY flag")
def ratio_quantiles(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("y_q05", "y_q50", "y_q95", "r_q05", "r_q50", "r_q95")), 4)


@query(f"WITH {STUDY} SELECT flag, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS iqr_ratio, round(stddev_samp(r), 6) AS sd_ratio FROM st GROUP BY flag")
def ratio_iqr(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("iqr_ratio", "sd_ratio")))


_BUNDLE = f"""WITH {STUDY}{_VEI}{_GINI}, v AS (
    SELECT flag, CASE WHEN min(CASE WHEN stratum IN (0, k - 1) THEN count END) >= 10 THEN 100 * (max(CASE WHEN stratum = k - 1 THEN median_ratio END) - max(CASE WHEN stratum = 0 THEN median_ratio END)) / any_value(m) END AS vei FROM prof GROUP BY flag),
    b AS (SELECT flag, count(*) AS n, any_value(m) AS median_ratio, sum(av) / sum(sp) AS wmean_ratio, 100 * avg(abs(r - m)) / any_value(m) AS cod, avg(r) / (sum(av) / sum(sp)) AS prd,
           regr_slope((r - m) / m, log2(0.5 * (av / m + sp))) AS prb, stddev_samp(r) / avg(r) AS cov_iaao FROM j GROUP BY flag),
    bundle AS (SELECT b.*, vei, gini_av / gini_sp AS mki FROM b JOIN v USING (flag) JOIN g USING (flag))"""
_MEASURES = ("median_ratio", "wmean_ratio", "cod", "prd", "prb", "cov_iaao", "vei", "mki")


def _bundle(spark, sf, only=_MEASURES):
    """Measures of the sales by flag; the keys, which settle ties of the strata, are kept only for these."""
    keys = KEYS if "vei" in only else ()
    return ratio_study.bundle(sales(spark, sf, ["flag", *keys]), ["flag"], keys=keys, only=only, held=True)


@query(f"{_BUNDLE} SELECT flag, n, {', '.join(f'round({c}, 6) AS {c}' for c in _MEASURES)} FROM bundle")
def ratio_bundle_by_group(spark, sf):
    return rounded(_bundle(spark, sf))


# Accuracy.


@query(f"WITH {STUDY} SELECT flag, round(1 - sum(pow(sp - av, 2)) / (var_pop(sp) * count(*)), 6) AS r2 FROM st GROUP BY flag")
def acc_r2(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("r2",)))


@query(f"WITH {STUDY} SELECT flag, round(1 - sum(pow(ln(sp) - ln(av), 2)) / (var_pop(ln(sp)) * count(*)), 6) AS r2_log FROM st GROUP BY flag")
def acc_r2_log(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("r2_log",)))


def _oos(spark, sf, scale):
    rows = sales(spark, sf)
    train, test = folds.year_split(rows, "d", 2000)
    mean = train.agg(F.avg(scale(F.col("sp"))).alias("base"))
    return rounded(ratio_study.oos_r2(test.crossJoin(F.broadcast(mean)), ["flag"], F.col("base")))


_OOS = f"WITH {STUDY}, tr AS (SELECT avg(SCALE) AS base FROM sales WHERE d < TIMESTAMP '2000-01-01') SELECT flag, round(1 - avg(pow(sp - av, 2)) / avg(pow(sp - base, 2)), 6) AS oos_r2 FROM st, tr WHERE d >= TIMESTAMP '2000-01-01' AND d < TIMESTAMP '2001-01-01' GROUP BY flag"


@query(_OOS.replace("SCALE", "ln(sp)"))
def acc_oos_r2_ref(spark, sf):
    return _oos(spark, sf, F.log)


@query(_OOS.replace("SCALE", "sp"))
def acc_oos_r2_price(spark, sf):
    return _oos(spark, sf, lambda c: c)


@query(f"WITH {STUDY} SELECT flag, round(sqrt(avg(pow(sp - av, 2))), 4) AS rmse, round(avg(abs(sp - av)), 4) AS mae, round(avg(av - sp), 4) AS bias FROM st GROUP BY flag")
def acc_rmse_mae(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("rmse", "mae", "bias")), 4)


@query(f"WITH {STUDY} SELECT flag, round(avg(abs(sp - av) / sp), 6) AS mape FROM st GROUP BY flag")
def acc_mape(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("mape",)))


@query(f"WITH {STUDY} SELECT flag, round(100 * quantile_cont(abs(sp / av - 1), 0.5), 6) AS mdape_pred, round(100 * quantile_cont(abs(av - sp) / sp, 0.5), 6) AS mdape_actual FROM st GROUP BY flag")
def acc_mdape_both(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("mdape_pred", "mdape_actual")))


@query(f"WITH {STUDY}, e AS (SELECT flag, ln(av) - ln(sp) AS e FROM st) SELECT flag, round(avg(abs(e)), 6) AS mae_log, round(sqrt(avg(e * e)), 6) AS rmse_log, round(avg(e), 6) AS bias_log, round(stddev_samp(e), 6) AS sd_log FROM e GROUP BY flag")
def acc_logratio(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("mae_log", "rmse_log", "bias_log", "sd_log")))


@query(f"WITH {STUDY}, c AS (SELECT flag, corr(r, sp) AS a, corr(r, ln(sp)) AS b FROM st GROUP BY flag) SELECT flag, round(a, 6) AS corr_r_price, round(b, 6) AS corr_r_logprice, round(atanh(greatest(least(a, 0.999999), -0.999999)), 6) AS fisher_z_r_y FROM c")
def corr_fisher(spark, sf):
    return rounded(ratio_study.accuracy(sales(spark, sf), ["flag"], only=("corr_r_price", "corr_r_logprice", "fisher_z_r_y")))


@query(f"WITH {STUDY} SELECT flag, round(regr_slope(r, ln(sp)), 6) AS slope_r_logy, round(1000 * regr_slope(r, sp), 6) AS slope_r_y, round(var_pop(r), 6) AS var_ratio, round(avg(CASE WHEN abs(sp) <= 10 * 2.220446049250313e-16 THEN 1 ELSE 0 END), 6) AS small_share FROM st GROUP BY flag")
def slope_ratio(spark, sf):
    out = ratio_study.accuracy(sales(spark, sf), ["flag"], only=("slope_r_logy", "slope_r_y", "var_ratio", "small_share"))
    return rounded(out.withColumn("slope_r_y", 1000 * F.col("slope_r_y")))


@query(f"WITH {STUDY}, q AS (SELECT flag, ln(av) - ln(sp) AS q, sp, ln(sp) AS y FROM st) SELECT flag, 'diff' AS fairness_ratio_mode, round(corr(q, sp), 6) AS corr_r_y_price, round(atanh(corr(q, sp)), 6) AS fisher_z_r_y_price, round(1000 * regr_slope(q, sp), 6) AS slope_r_y_price, round(var_pop(q), 6) AS var_r, round(var_pop(y), 6) AS var_y, count(*) AS val_rows FROM q GROUP BY flag")
def ratio_mode_diff(spark, sf):
    out = ratio_study.ratio_mode(sales(spark, sf), ["flag"], "diff")
    return rounded(out.withColumn("slope_r_y_price", 1000 * F.col("slope_r_y_price")))


@query(f"WITH {STUDY} SELECT flag, round(1000 * regr_slope(av, sp), 6) AS slope, round(regr_intercept(av, sp), 4) AS intercept FROM st GROUP BY flag")
def line_fit(spark, sf):
    out = ratio_study.line_fit(sales(spark, sf), ["flag"], "av", "sp")
    return out.select("flag", F.round(1000 * F.col("slope"), 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("WITH c AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), a AS (SELECT x, sum(n) AS nx FROM c GROUP BY x), b AS (SELECT y, sum(n) AS ny FROM c GROUP BY y) SELECT round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM c JOIN a USING (x) JOIN b USING (y), t")
def mutual_information(spark, sf):
    cells = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("x"), F.col("c_mktsegment").alias("y")).agg(F.count("*").alias("n"))
    return rounded(dependence.mutual_information(cells, "x", "y"))


# Strata.

_STRATA = f"""WITH {STUDY}, edges AS (SELECT list_distinct(quantile_cont(sp, [0.2, 0.4, 0.6, 0.8])) AS e FROM st),
    b AS (SELECT st.*, (len(list_filter(e, lambda x: x < sp)) + 1)::INTEGER AS stratum FROM st, edges),
    bm AS (SELECT stratum, quantile_cont(r, 0.5) AS m FROM b GROUP BY stratum), bj AS (SELECT * FROM b JOIN bm USING (stratum))
    SELECT stratum, count(*) AS count, min(sp) AS min_price, max(sp) AS max_price, round(avg(av - sp), 4) AS mean_error, round(100 * avg(abs(av - sp) / sp), 4) AS mape_pct, round(avg(r), 4) AS mean_ratio,
           round(any_value(m), 4) AS median_ratio, round(avg(r) / (sum(av) / sum(sp)), 4) AS prd, round(100 * avg(abs(r - m)) / any_value(m), 4) AS cod, round(regr_slope((r - m) / m, log2(0.5 * (av / m + sp))), 4) AS prb
    FROM bj GROUP BY stratum"""


@query(_STRATA)
def strata_quantile_report(spark, sf):
    return rounded(ratio_study.quantile_report(sales(spark, sf), 5), 4)


@query(f"WITH {SALES}, e AS (SELECT min(sp) AS lo, max(sp) + 1e-6 AS hi FROM sales), b AS (SELECT least(floor((sp - lo) / ((hi - lo) / 8)), 7)::INTEGER AS bin, sp FROM sales, e) SELECT bin, count(*) AS count, round(avg(sp), 4) AS mean_price FROM b GROUP BY bin")
def strata_equal_width(spark, sf):
    return rounded(ratio_study.equal_width_bins(sales(spark, sf), "sp", 8).groupBy("bin").agg(F.count("*").alias("count"), F.avg("sp").alias("mean_price")), 4)


@query(f"WITH {SALES}, g AS (SELECT brand, avg(abs(ln(sp) - ln(av))) AS mae, avg(pow(ln(sp) - ln(av), 2)) AS mse FROM sales GROUP BY brand) SELECT round(max(mae), 6) AS max_mae, round(max(mae) - min(mae), 6) AS spread_mae, round(max(mse), 6) AS max_mse, round(max(mse) - min(mse), 6) AS spread_mse FROM g")
def strata_group_spread(spark, sf):
    rows = sales(spark, sf).withColumns({"y": F.log("sp"), "f": F.log("av")})
    return rounded(ratio_study.group_spread(rows, "brand", "y", "f"))


# Flags.


def _flag_sql(x: str, low: float, high: float, margin: float) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'NA' WHEN {x} BETWEEN {low} AND {high} THEN 'PASS' WHEN {x} BETWEEN {low - margin} AND {high + margin} THEN 'WARN' ELSE 'FAIL' END"


def _worst_sql(*xs: str) -> str:
    listed = ", ".join(xs)
    return f"CASE WHEN 'FAIL' IN ({listed}) THEN 'FAIL' WHEN 'WARN' IN ({listed}) THEN 'WARN' WHEN 'PASS' IN ({listed}) THEN 'PASS' ELSE 'NA' END"


_CARD = f"""{_BUNDLE}, f AS (SELECT *, {_flag_sql("median_ratio", *flags.LEVEL, 0.02)} AS f1, {_flag_sql("wmean_ratio", *flags.LEVEL, 0.02)} AS f2, {_flag_sql("cod", *flags.COD_RANGE, 1.0)} AS uniformity,
        {_flag_sql("prd", *flags.PRD, 0.02)} AS f3, {_flag_sql("prb", *flags.PRB, 0.01)} AS f4, {_flag_sql("vei", *flags.VEI, 2.0)} AS f5 FROM bundle),
    card AS (SELECT *, {_worst_sql("f1", "f2")} AS level, {_worst_sql("f3", "f4", "f5")} AS vertical FROM f)"""


@query(f"{_CARD} SELECT flag, level, uniformity, vertical, {_worst_sql('level', 'uniformity', 'vertical')} AS verdict FROM card")
def flags_scorecard(spark, sf):
    return flags.scorecard(_bundle(spark, sf)).select("flag", "level", "uniformity", "vertical", "verdict")


@query(f"{_BUNDLE}, base AS (SELECT cod AS c0, prd AS p0, prb AS b0 FROM bundle WHERE flag = 'N') SELECT flag, round(cod - c0, 6) AS d_cod, round(prd - p0, 6) AS d_prd, round(prb - b0, 6) AS d_prb FROM bundle, base")
def flags_delta_baseline(spark, sf):
    return rounded(flags.delta_vs_baseline(_bundle(spark, sf, ("cod", "prd", "prb")), "flag", "N", ("cod", "prd", "prb")).select("flag", "d_cod", "d_prd", "d_prb"))


@query(f"WITH {STUDY}, p AS (SELECT brand, avg(r) / (sum(av) / sum(sp)) AS prd FROM st GROUP BY brand) SELECT brand, {_flag_sql('prd', *flags.PRD, 0.02)} AS prd_flag, CASE WHEN prd > 1.03 THEN 'regressive' WHEN prd < 0.98 THEN 'progressive' ELSE 'neutral' END AS reading FROM p")
def flags_verdict(spark, sf):
    p = ratio_study.accuracy(sales(spark, sf), ["brand"], only=("prd",))
    reading = F.when(F.col("prd") > flags.PRD[1], "regressive").when(F.col("prd") < flags.PRD[0], "progressive").otherwise("neutral")
    return p.select("brand", flags.range_flag(F.col("prd"), flags.PRD, flags.MARGINS["prd"]).alias("prd_flag"), reading.alias("reading"))


@query(f"{_BUNDLE}, l AS (SELECT flag, unnest(['cod', 'prd', 'prb']) AS metric, unnest([cod, prd, prb]) AS v FROM bundle) SELECT metric, round(max(CASE WHEN flag = 'A' THEN v END), 6) AS \"A\", round(max(CASE WHEN flag = 'N' THEN v END), 6) AS \"N\", round(max(CASE WHEN flag = 'R' THEN v END), 6) AS \"R\" FROM l GROUP BY metric")
def flags_transposed(spark, sf):
    return rounded(flags.transposed(_bundle(spark, sf, ("cod", "prd", "prb")), "flag", ("cod", "prd", "prb")))


# Splits and folds.


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT coalesce(o_orderpriority = '1-URGENT', true) AND NOT coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice > 400000 END, true) GROUP BY ALL")
def split_validity(spark, sf):
    rows = ordered(spark, sf).withColumns({"urgent": F.col("o_orderpriority") == "1-URGENT", "outlier": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 400000)})
    return folds.valid_sales(rows, ["urgent", "outlier"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(0.9 * count(*) OVER ()) AS is_train FROM orders) SELECT is_train, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderdate) AS last_date, round(sum(o_totalprice), 2) AS total FROM p GROUP BY is_train")
def split_time_holdout(spark, sf):
    rows = folds.time_holdout(ordered(spark, sf), "o_orderdate", ["o_orderkey"], 0.9)
    return rounded(rows.groupBy("is_train").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderdate").alias("last_date"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'before' ELSE 'year' END AS part, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY ALL")
def split_year(spark, sf):
    before, year = folds.year_split(ordered(spark, sf), "o_orderdate", 2000)
    both = before.withColumn("part", F.lit("before")).unionByName(year.withColumn("part", F.lit("year")))
    return rounded(both.groupBy("part").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price")), 4)


def _mode_a(spark, sf, sliding):
    rows = ordered(spark, sf)
    n, initial = folds.initial_rows(rows, "o_orderdate", 12, 100)
    table_ = spark.createDataFrame(folds.mode_a_folds(n, initial, 0.1, sliding), folds.FOLD_SCHEMA)
    return folds.position_membership(with_position(rows, ["o_orderdate", "o_orderkey"]), table_)


def _fold_sizes(rows):
    return rounded(rows.groupBy("fold_id", "role").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.avg("o_totalprice").alias("mean_price")), 4)


_MODE_A = """WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders),
    s AS (SELECT count(*) AS n, greatest(count(*) FILTER (o_orderdate < (SELECT min(o_orderdate) FROM orders) + INTERVAL 12 MONTH), 100) AS init, greatest(floor(0.1 * count(*))::BIGINT, 1) AS size FROM orders),
    f AS (SELECT i AS fold_id, START AS train_start, init + i * size AS train_end, init + (i + 1) * size AS val_end FROM s, range(0, 20) t(i) WHERE init + (i + 1) * size <= n)
    SELECT fold_id, CASE WHEN pos < train_end THEN 'train' ELSE 'val' END AS role, count(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, round(avg(o_totalprice), 4) AS mean_price
    FROM p JOIN f ON pos >= train_start AND pos < val_end GROUP BY ALL"""


@query(_MODE_A.replace("START", "0"))
def folds_mode_a(spark, sf):
    return _fold_sizes(_mode_a(spark, sf, False))


@query(_MODE_A.replace("START", "i * size"))
def folds_sliding(spark, sf):
    return _fold_sizes(_mode_a(spark, sf, True))


@query("""WITH b AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders),
    f AS (SELECT row_number() OVER (ORDER BY i) - 1 AS fold_id, a AS s, (a + to_months((18 + 6 * i)::INTEGER))::DATE AS v, ((a + to_months((18 + 6 * i)::INTEGER))::DATE + INTERVAL 3 MONTH)::DATE AS e FROM b, range(0, 40) t(i) WHERE ((a + to_months((18 + 6 * i)::INTEGER))::DATE + INTERVAL 3 MONTH)::DATE <= z + 1)
    SELECT fold_id, CASE WHEN o_orderdate::DATE < v THEN 'train' ELSE 'val' END AS role, count(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, round(avg(o_totalprice), 4) AS mean_price
    FROM orders JOIN f ON o_orderdate::DATE >= s AND o_orderdate::DATE < e GROUP BY ALL""")
def folds_mode_b(spark, sf):
    rows = ordered(spark, sf)
    a, z = rows.agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    table_ = spark.createDataFrame(folds.mode_b_folds(a, z, 18, 3, 6), folds.DATE_FOLD_SCHEMA)
    return _fold_sizes(folds.date_membership(rows, table_, "o_orderdate"))


@query(f"WITH m AS ({_MODE_A.replace('START', '0')}) SELECT role, count(*) AS folds, sum(n)::BIGINT AS row_count FROM m GROUP BY role")
def fold_membership_counts(spark, sf):
    return _mode_a(spark, sf, False).groupBy("role").agg(F.count_distinct("fold_id").alias("folds"), F.count("*").alias("row_count"))


def _origins(spark, sf, sliding):
    rows = ordered(spark, sf)
    a, z = rows.agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    found = folds.rolling_origins(a, z)
    pairs = folds.sliding_starts(a, found) if sliding else [(None, o) for o in found]
    table_ = spark.createDataFrame(pairs, "window_start date, origin date")
    return folds.origin_membership(rows, table_, "o_orderdate").groupBy("origin").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


_ORIGINS = """WITH b AS (SELECT min(o_orderdate)::DATE + 270 AS a, max(o_orderdate)::DATE AS z FROM orders),
    o AS (SELECT (CASE WHEN day(a) = 1 THEN a ELSE (date_trunc('month', a) + INTERVAL 1 MONTH)::DATE END + to_months((9 * i)::INTEGER))::DATE AS origin, z FROM b, range(0, 40) t(i))
    SELECT origin, count(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders JOIN o ON o_orderdate::DATE <= origin AND origin <= z WINDOWED GROUP BY origin"""


@query(_ORIGINS.replace("WINDOWED", ""))
def legacy_origin_folds(spark, sf):
    return _origins(spark, sf, False)


@query(_ORIGINS.replace("WINDOWED", "AND o_orderdate::DATE > make_date((year(origin) - 3 + CASE WHEN month(origin) = 1 AND day(origin) = 1 THEN 0 ELSE 1 END)::INTEGER, 1, 1)"))
def legacy_sliding_folds(spark, sf):
    return _origins(spark, sf, True)


# Bootstrap.


@query("SELECT date_trunc('month', o_orderdate) AS block, count(*) AS n, max(pos) AS last_pos FROM (SELECT o_orderdate, row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders) GROUP BY ALL")
def boot_blocks(spark, sf):
    return bootstrap.in_blocks(ordered(spark, sf), "o_orderdate", "month", ["o_orderkey"]).groupBy("block").agg(F.count("*").alias("n"), F.max("pos_in_block").alias("last_pos"))


def _resampled(spark, sf, n=8):
    rows = staged(bootstrap.in_blocks(ordered(spark, sf), "o_orderdate", "month", ["o_orderkey"]).select("block", "pos_in_block", "o_orderkey", "o_totalprice"))
    sizes = bootstrap.block_sizes(rows)
    drawn = bootstrap.draws([n for _, n in sizes], n, bootstrap.stepping_picker(len(sizes)))
    return bootstrap.multiplicity(spark, rows, [b for b, _ in sizes], drawn)


_DRAWS = """WITH p AS (SELECT o_orderkey, o_totalprice, date_trunc('month', o_orderdate) AS block, row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders),
    sizes AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS block_no, count(*) AS n FROM p GROUP BY block),
    tot AS (SELECT sum(n) AS total, count(*) AS k FROM sizes),
    seqs AS (SELECT b, i, (7919 * b + 104729 * i) % k AS block_no, total FROM tot, range(0, 8) x(b), range(0, 400) y(i)),
    held AS (SELECT s.*, n, coalesce(sum(n) OVER (PARTITION BY b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seqs s JOIN sizes USING (block_no)),
    draws AS (SELECT b AS bootstrap_id, i, block_no, least(n, total - before) AS take_n FROM held WHERE before < total),
    mult AS (SELECT bootstrap_id, o_orderkey, o_totalprice, pos, count(*) AS mult FROM draws JOIN sizes USING (block_no) JOIN p USING (block) WHERE pos < take_n GROUP BY ALL)"""


@query(f"{_DRAWS} SELECT bootstrap_id, count(*) AS row_count, sum(mult)::BIGINT AS total, max(mult) AS top, round(sum(mult * o_totalprice) / sum(mult), 4) AS mean_price FROM mult GROUP BY bootstrap_id")
def boot_multiplicity(spark, sf):
    w = F.col("mult")
    return rounded(_resampled(spark, sf).groupBy("bootstrap_id").agg(F.count("*").alias("row_count"), F.sum(w).alias("total"), F.max(w).alias("top"), (F.sum(w * F.col("o_totalprice")) / F.sum(w)).alias("mean_price")), 4)


@query(f"""{_DRAWS}, e AS (SELECT bootstrap_id, o_totalprice AS sp, 0.8 * o_totalprice + 20000 + pos AS av FROM mult, range(0, 400) t(c) WHERE c < mult),
    m AS (SELECT bootstrap_id, quantile_cont(av / sp, 0.5) AS m, avg(av / sp) / (sum(av) / sum(sp)) AS prd FROM e GROUP BY ALL),
    s AS (SELECT bootstrap_id, any_value(m) AS median_ratio, any_value(prd) AS prd, 100 * avg(abs(av / sp - m)) / any_value(m) AS cod FROM e JOIN m USING (bootstrap_id) GROUP BY ALL),
    l AS (SELECT unnest(['median_ratio', 'cod', 'prd']) AS metric, unnest([median_ratio, cod, prd]) AS v FROM s)
    SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM l GROUP BY metric""")
def boot_mean_std(spark, sf):
    rows = _resampled(spark, sf).withColumnRenamed("o_totalprice", "sp").withColumn("av", 0.8 * F.col("sp") + 20000 + F.col("pos_in_block"))
    return rounded(bootstrap.mean_and_spread(bootstrap.weighted_study(rows), ("median_ratio", "cod", "prd")))


_WHOLE = ("n", "r2", "r2_log", "rmse", "mae", "mape", "mdape_pred", "mdape_actual", "bias", "corr_r_price", "corr_r_logprice", "fisher_z_r_y", "slope_r_logy", "var_ratio", "mean_ratio", "median_ratio", "wmean_ratio", "cov_iaao", "prd", "sd_ratio", "iqr_ratio", "mae_log", "rmse_log", "bias_log", "sd_log", "mean_price", "y_q05", "y_q50", "y_q95", "r_q05", "r_q50", "r_q95", "cod", "prb", "vei", "gini_av", "gini_sp", "ki", "mki")


def whole_study_sql(group: str, rows: str, ties: str) -> str:
    """Common table expressions that end in ``whole``: all measures of the rows (group, sp, av, ties) in ``rows``, one by one."""
    return f"""st AS (SELECT *, av / sp AS r FROM {rows} WHERE av > 0 AND sp > 0),
    one AS (SELECT {group} AS g, count(*) AS n, quantile_cont(r, 0.5) AS m FROM st GROUP BY {group}),
    j AS (SELECT st.*, n, m, 0.5 * sp + 0.5 * av / m AS proxy FROM st JOIN one ON st.{group} IS NOT DISTINCT FROM one.g),
    acc AS (SELECT {group} AS g, count(*) AS n, 1 - sum(pow(sp - av, 2)) / nullif(var_pop(sp) * count(*), 0) AS r2, 1 - sum(pow(ln(sp) - ln(av), 2)) / nullif(var_pop(ln(sp)) * count(*), 0) AS r2_log,
           sqrt(avg(pow(sp - av, 2))) AS rmse, avg(abs(sp - av)) AS mae, avg(abs(sp - av) / sp) AS mape, 100 * quantile_cont(abs(sp / av - 1), 0.5) AS mdape_pred, 100 * quantile_cont(abs(av - sp) / sp, 0.5) AS mdape_actual,
           avg(av - sp) AS bias, corr(r, sp) AS corr_r_price, corr(r, ln(sp)) AS corr_r_logprice, atanh(greatest(least(corr(r, sp), 0.999999), -0.999999)) AS fisher_z_r_y, regr_slope(r, ln(sp)) AS slope_r_logy,
           var_pop(r) AS var_ratio, avg(r) AS mean_ratio, any_value(m) AS median_ratio, sum(av) / sum(sp) AS wmean_ratio, stddev_samp(r) / avg(r) AS cov_iaao, avg(r) / (sum(av) / sum(sp)) AS prd,
           coalesce(stddev_samp(r), 0) AS sd_ratio, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS iqr_ratio, avg(abs(ln(av / sp))) AS mae_log, sqrt(avg(pow(ln(av / sp), 2))) AS rmse_log, avg(ln(av / sp)) AS bias_log,
           stddev_samp(ln(av) - ln(sp)) AS sd_log, avg(sp) AS mean_price, {", ".join(f"quantile_cont({c}, {q / 100}) AS {a}_q{q:02d}" for c, a in (("sp", "y"), ("r", "r")) for q in (5, 50, 95))},
           100 * avg(abs(r - m)) / any_value(m) AS cod, regr_slope((r - m) / m, log2(0.5 * (av / m + sp))) AS prb FROM j GROUP BY {group}),
    cut AS (SELECT *, CASE WHEN n < 20 THEN NULL WHEN n <= 50 THEN 2 WHEN n <= 500 THEN 4 ELSE 10 END AS k, row_number() OVER (PARTITION BY {group} ORDER BY proxy, {ties}) AS pos FROM j),
    strata AS (SELECT *, CASE WHEN pos <= (n // k + 1) * (n % k) THEN (pos - 1) // (n // k + 1) ELSE n % k + (pos - 1 - (n // k + 1) * (n % k)) // (n // k) END AS stratum FROM cut WHERE k IS NOT NULL),
    prof AS (SELECT {group} AS g, stratum, count(*) AS c, quantile_cont(r, 0.5) AS mr, any_value(m) AS m, any_value(k) AS k FROM strata GROUP BY {group}, stratum),
    v AS (SELECT g, CASE WHEN min(CASE WHEN stratum IN (0, k - 1) THEN c END) >= 10 THEN 100 * (max(CASE WHEN stratum = k - 1 THEN mr END) - max(CASE WHEN stratum = 0 THEN mr END)) / any_value(m) END AS vei FROM prof GROUP BY g),
    gp AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY sp, av DESC) AS pos FROM st),
    gi AS (SELECT {group} AS g, (2 * sum(av * pos) / sum(av) - (count(*) + 1)) / count(*) AS gini_av, (2 * sum(sp * pos) / sum(sp) - (count(*) + 1)) / count(*) AS gini_sp FROM gp GROUP BY {group}),
    whole AS (SELECT acc.g AS {group}, acc.* EXCLUDE (g), vei, gini_av, gini_sp, gini_av - gini_sp AS ki, gini_av / gini_sp AS mki FROM acc LEFT JOIN v ON acc.g IS NOT DISTINCT FROM v.g LEFT JOIN gi ON acc.g IS NOT DISTINCT FROM gi.g)"""


def whole_columns(names: Sequence[str] = _WHOLE) -> str:
    return ", ".join(c if c == "n" else f"round({c}, 4) AS {c}" for c in names)


@query(f"{_DRAWS}, e AS (SELECT bootstrap_id, o_orderkey, c, o_totalprice AS sp, 0.8 * o_totalprice + 20000 + pos AS av FROM mult, range(0, 400) t(c) WHERE c < mult), {whole_study_sql('bootstrap_id', 'e', 'o_orderkey, c')} SELECT bootstrap_id, {whole_columns()} FROM whole")
def boot_whole_study(spark, sf):
    rows = _resampled(spark, sf).withColumnRenamed("o_totalprice", "sp").withColumn("av", 0.8 * F.col("sp") + 20000 + F.col("pos_in_block"))
    return rounded(ratio_study.weighted_bundle(rows, ["bootstrap_id"], "mult", keys=["o_orderkey"]).select("bootstrap_id", *_WHOLE), 4)


_SOME_NULL = "nullif(brand, (SELECT min(brand) FROM sales))"


@query(f"WITH {SALES}, x AS (SELECT {_SOME_NULL} AS grp, * FROM sales), {whole_study_sql('grp', 'x', 'k1, k2, k3, k4')} SELECT grp, {whole_columns()} FROM whole")
def ratio_null_group(spark, sf):
    rows = sales(spark, sf)
    least = rows.agg(F.min("brand").alias("_least"))
    rows = rows.crossJoin(F.broadcast(least)).withColumn("grp", F.when(F.col("brand") != F.col("_least"), F.col("brand")))
    return rounded(ratio_study.bundle(rows, ["grp"], keys=KEYS).select("grp", *_WHOLE), 4)


# Summaries.


@query(f"WITH {RUNS} SELECT config_id, model_name, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in ("r2", "prd", "prb", "vei")) + " FROM runs GROUP BY ALL")
def summary_by_config(spark, sf):
    return rounded(summary.by_config(runs(spark, sf), ["config_id", "model_name"], ("r2", "prd", "prb", "vei")))


@query(f"WITH {RUNS} SELECT config_id, round(avg(r2), 8) AS mean FROM runs GROUP BY config_id ORDER BY avg(r2) DESC, config_id LIMIT 3")
def topk_configs(spark, sf):
    return rounded(summary.top_configs(runs(spark, sf), "config_id", "r2", 3), 8)


@query(f"WITH {RUNS}, t AS (SELECT config_id FROM runs GROUP BY config_id ORDER BY avg(r2) DESC, config_id LIMIT 2) SELECT config_id, min(p)::INTEGER AS priority FROM (SELECT DISTINCT config_id, 0 AS p FROM runs WHERE config_id IN ('AF', 'NO') UNION ALL SELECT config_id, 1 FROM t) GROUP BY config_id")
def selected_configs(spark, sf):
    return summary.selected_configs(runs(spark, sf), "config_id", "r2", 2, ["AF", "NO"])


@query(f"WITH {RUNS}, m AS (SELECT fold_id, avg(r2) AS mean FROM runs GROUP BY fold_id) SELECT fold_id, round(mean, 8) AS mean FROM m ORDER BY m.mean, fold_id LIMIT 1")
def hardest_fold(spark, sf):
    return rounded(summary.hardest_fold(runs(spark, sf), "fold_id", "r2"), 8)


@query(f"WITH {RUNS}, h AS (SELECT * FROM runs WHERE NOT (config_id = 'AF' AND fold_id = 2)), k AS (SELECT fold_id FROM h GROUP BY fold_id HAVING count(DISTINCT config_id) = (SELECT count(DISTINCT config_id) FROM h)), c AS (SELECT config_id FROM h GROUP BY config_id HAVING count(DISTINCT fold_id) = (SELECT count(DISTINCT fold_id) FROM h)) SELECT fold_id, config_id, round(r2, 8) AS r2 FROM h WHERE fold_id IN (SELECT fold_id FROM k) AND config_id IN (SELECT config_id FROM c)")
def complete_grid(spark, sf):
    holed = runs(spark, sf).where("NOT (config_id = 'AF' AND fold_id = 2)")
    return rounded(summary.complete_grid(holed, "fold_id", "config_id").select("fold_id", "config_id", "r2"), 8)


@query("WITH p AS (SELECT p_partkey, p_size AS gain, p_retailprice AS loss FROM part) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.gain >= a.gain AND b.loss <= a.loss AND (b.gain > a.gain OR b.loss < a.loss))")
def pareto_front(spark, sf):
    points = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("gain"), F.col("p_retailprice").alias("loss"))
    return summary.pareto_front(points, "gain", "loss")


@query(f"WITH {RUNS}, c AS (SELECT config_id, round(avg(r2), 8) AS gain, round(abs(avg(prd) - 1), 8) AS loss FROM runs GROUP BY ALL) SELECT *, NOT EXISTS (SELECT 1 FROM c b WHERE b.gain >= a.gain AND b.loss <= a.loss AND (b.gain > a.gain OR b.loss < a.loss)) AS is_pareto, config_id IN ('AF') AS is_baseline FROM c a")
def tradeoff_points(spark, sf):
    points = runs(spark, sf).groupBy("config_id").agg(F.round(F.avg("r2"), 8).alias("gain"), F.round(F.abs(F.avg("prd") - 1), 8).alias("loss"))
    return summary.tradeoff(points, "config_id", "gain", "loss", ["AF"])


@query(f"""WITH {RUNS}, c AS (SELECT config_id, round(avg(r2), 8) AS gain, round(abs(avg(prd) - 1), 8) AS prd, round(abs(avg(prb)), 8) AS prb, round(abs(avg(vei)), 8) AS vei FROM runs GROUP BY ALL),
    l AS (SELECT config_id, gain, unnest(['prd', 'prb', 'vei']) AS measure, unnest([prd, prb, vei]) AS loss, unnest([0.02, 0, 0])::DOUBLE AS band_lo, unnest([0.03, 0.05, 10])::DOUBLE AS band_hi FROM c)
    SELECT *, loss <= band_hi AS within, config_id IN ('AF') AS is_baseline,
           NOT EXISTS (SELECT 1 FROM l b WHERE b.measure = a.measure AND b.gain >= a.gain AND b.loss <= a.loss AND (b.gain > a.gain OR b.loss < a.loss)) AS is_pareto FROM l a""")
def tradeoff_bands(spark, sf):
    deviations = {"prd_dev": F.round(F.abs(F.avg("prd") - 1), 8), "prb_dev": F.round(F.abs(F.avg("prb")), 8), "vei_dev": F.round(F.abs(F.avg("vei")), 8)}
    means = runs(spark, sf).groupBy("config_id").agg(F.round(F.avg("r2"), 8).alias("r2"), *(v.alias(k) for k, v in deviations.items()))
    return summary.banded_tradeoffs(means, "config_id", "r2", ["AF"])


@query(f"WITH {RUNS}, l AS (SELECT fold_id, model_name, unnest(['r2', 'prd', 'vei']) AS metric, unnest([r2, prd, vei]) AS v FROM runs) SELECT fold_id, model_name, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM l GROUP BY ALL")
def evolution_long(spark, sf):
    return rounded(summary.evolution(runs(spark, sf), ["fold_id", "model_name"], ("r2", "prd", "vei")))


_WEIGHTS = "w(config_id, weight) AS (VALUES ('AF', 0.5), ('NO', 0.3), ('RF', 0.2))"


def _weights(spark):
    return spark.createDataFrame([("AF", 0.5), ("NO", 0.3), ("RF", 0.2)], "config_id string, weight double")


@query(f"WITH {RUNS}, {_WEIGHTS} SELECT fold_id, round(sum(weight * r2), 6) AS r2_ensemble, round(sum(weight * prd), 6) AS prd_ensemble FROM runs JOIN w USING (config_id) GROUP BY fold_id")
def stack_linear(spark, sf):
    return rounded(summary.linear_ensemble(runs(spark, sf), _weights(spark), "fold_id", "config_id", ("r2", "prd")))


_BLEND = f"""WITH {_WEIGHTS}, e AS (SELECT l_orderkey AS row_id, l_returnflag || l_linestatus AS config_id, avg(ln(l_extendedprice)) AS f, min(l_shipdate) AS d FROM lineitem GROUP BY ALL),
    b AS (SELECT row_id, sum(weight * f) AS blend, count(*) AS k, min(d) AS d FROM e JOIN w USING (config_id) GROUP BY row_id HAVING count(*) = 3)"""


#: Line items to a task.
_TASK_ROWS = 500_000


def _blend(spark, sf):
    lines, weights = table(spark, sf, "lineitem"), _weights(spark)
    # Rows are dealt out once, by what both groupings share, so that no task gets more with a larger table.
    rows = lines.select(F.col("l_orderkey").alias("row_id"), F.concat("l_returnflag", "l_linestatus").alias("config_id"), "l_extendedprice", "l_shipdate").join(F.broadcast(weights), "config_id", "left_semi")
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, lines.count() // _TASK_ROWS + 1), "row_id")
    predictions = rows.groupBy("row_id", "config_id").agg(F.avg(F.log("l_extendedprice")).alias("f"), F.min("l_shipdate").alias("d"))
    return summary.blended(predictions, weights, "row_id", "config_id", "f", others={"d": F.min("d")})


@query(f"{_BLEND} SELECT row_id, round(blend, 6) AS blend FROM b")
def stack_blend(spark, sf):
    return rounded(_blend(spark, sf).select("row_id", "blend"))


@query(f"{_BLEND}, q AS (SELECT date_trunc('quarter', d) AS period, count(*) AS n, avg(blend) AS score FROM b GROUP BY ALL HAVING count(*) >= 2) SELECT period, n, round(score, 6) AS score FROM q ORDER BY q.score, period LIMIT 1")
def stack_worst_quarter(spark, sf):
    return rounded(summary.worst_period(_blend(spark, sf), "d", "quarter", F.avg("blend")))


_STACKED = f"""{_BLEND}, truth AS (SELECT l_orderkey AS row_id, avg(ln(l_extendedprice)) AS y FROM lineitem GROUP BY ALL),
    x AS (SELECT row_id, 'all' AS part, d, exp(y) AS sp, exp(blend) AS av FROM b JOIN truth USING (row_id)),"""


def _stacked(spark, sf):
    truth = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.avg(F.log("l_extendedprice")).alias("y"))
    return _blend(spark, sf).join(truth, "row_id").withColumn("part", F.lit("all"))


@query(f"{_STACKED} {whole_study_sql('part', 'x', 'row_id')} SELECT part, {whole_columns()} FROM whole")
def stack_test_study(spark, sf):
    return rounded(summary.blend_study(_stacked(spark, sf), "y", "blend", ["part"], ["row_id"]).select("part", *_WHOLE), 4)


@query(f"{_STACKED} z AS (SELECT row_id, date_trunc('quarter', d) AS period, sp, av FROM x), {whole_study_sql('period', 'z', 'row_id')} SELECT period, {whole_columns()} FROM whole WHERE n >= 2 AND r2 IS NOT NULL ORDER BY whole.r2, period LIMIT 1")
def stack_worst_study(spark, sf):
    return rounded(summary.worst_study(_stacked(spark, sf), "y", "blend", "d", "quarter", ["row_id"]).select("period", *_WHOLE), 4)


# Joins, sets, ranks, samples.


@query("SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def join_anti_pending(spark, sf):
    planned = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id")).distinct()
    status = ordered(spark, sf).select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return summary.pending(planned, status)


@query("SELECT * FROM (SELECT c_nationkey AS k, count(*) AS customers, NULL::BIGINT AS suppliers FROM customer GROUP BY ALL UNION ALL SELECT s_nationkey, NULL, count(*) FROM supplier GROUP BY ALL)")
def union_ragged_counts(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return union_ragged([a, b])


@query(f"WITH {RUNS} SELECT fold_id, " + ", ".join(f"round(max(CASE WHEN config_id = '{c}' THEN r2 END), 8) AS \"{c}\"" for c in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM runs GROUP BY fold_id")
def pivot_first(spark, sf):
    return rounded(runs(spark, sf).groupBy("fold_id").pivot("config_id", ["AF", "AO", "NF", "NO", "RF", "RO"]).agg(F.first("r2")), 8)


@query("SELECT s_suppkey, (rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2) / count(*) OVER (PARTITION BY s_nationkey) AS u FROM supplier")
def window_average_rank(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", average_rank("s_acctbal", ["s_nationkey"]).alias("u"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def window_first_per_key(spark, sf):
    return first_per_key(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (), 4) AS centred FROM supplier")
def window_global_mean(spark, sf):
    return global_mean(table(spark, sf, "supplier"), "s_acctbal").select("s_suppkey", F.round(F.col("s_acctbal") - F.col("global_mean"), 4).alias("centred"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey || '|2025'), o_orderkey) AS place FROM orders) WHERE place <= floor(0.1 * (SELECT count(*) FROM orders))")
def exact_fraction_sample(spark, sf):
    return exact_sample(ordered(spark, sf), 0.1, ["o_orderkey"], 2025)


@query("SELECT c_mktsegment, substr(sha256('{\"alpha\":0.1,\"segment\":\"' || c_mktsegment || '\"}'), 1, 16) AS config_id FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def stable_hash_ids(spark, sf):
    config = F.struct(F.lit(0.1).alias("alpha"), F.col("c_mktsegment").alias("segment"))
    return table(spark, sf, "customer").select("c_mktsegment").distinct().withColumn("config_id", stable_id_column(config))


# Features.


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")


_CUST = "c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS c_mktsegment, c_nationkey FROM customer)"


@query(f"WITH {_CUST}, s AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM c), o AS (SELECT c_mktsegment AS top FROM c WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT c_custkey, round(coalesce(c_acctbal, m), 6) AS c_acctbal, coalesce(c_mktsegment, top) AS c_mktsegment FROM c, s, o")
def feat_impute(spark, sf):
    return rounded(features.Imputer(["c_acctbal"], ["c_mktsegment"]).fit_transform(_customers(spark, sf)).select("c_custkey", "c_acctbal", "c_mktsegment"))


@query(f"WITH {_CUST}, k AS (SELECT DISTINCT c_mktsegment AS v FROM c WHERE c_nationkey < 3 AND c_mktsegment IS NOT NULL AND c_mktsegment <> 'BUILDING') SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN 'unknown' WHEN v IS NULL THEN 'new' ELSE v END AS coded FROM c LEFT JOIN k ON v = c_mktsegment")
def feat_category_codes(spark, sf):
    rows = _customers(spark, sf)
    step = features.CategoryCoder(["c_mktsegment"]).fit(rows.where("c_nationkey < 3 AND c_mktsegment <> 'BUILDING'"))
    return step.transform(rows).select("c_custkey", F.col("c_mktsegment").alias("coded"))


@query(f"WITH {_CUST}, k AS (SELECT DISTINCT c_mktsegment AS v FROM c WHERE c_nationkey < 3 AND c_mktsegment <> 'BUILDING') SELECT c_custkey, CASE WHEN c_mktsegment IS NOT NULL AND v IS NULL THEN 'unknown' ELSE c_mktsegment END AS c_mktsegment FROM c LEFT JOIN k ON v = c_mktsegment")
def feat_novel(spark, sf):
    rows = _customers(spark, sf)
    return features.NovelCategories(["c_mktsegment"]).fit(rows.where("c_nationkey < 3 AND c_mktsegment <> 'BUILDING'")).transform(rows).select("c_custkey", "c_mktsegment")


_ENCODED = f"WITH {_CUST}, m AS (SELECT c_mktsegment AS v, avg(c_acctbal) AS m FROM c WHERE c_nationkey < 5 AND c_mktsegment IS NOT NULL GROUP BY 1), g AS (SELECT avg(c_acctbal) AS g FROM c WHERE c_nationkey < 5) SELECT c_custkey, round(coalesce(m, g), 4) AS c_mktsegment FROM c LEFT JOIN m ON v = c_mktsegment, g"


@query(_ENCODED)
def feat_target_encode(spark, sf):
    rows = _customers(spark, sf)
    return rounded(features.TargetEncoder(["c_mktsegment"], "c_acctbal").fit(rows.where("c_nationkey < 5")).transform(rows).select("c_custkey", "c_mktsegment"), 4)


@query(_ENCODED)
def join_lookup_default(spark, sf):
    return feat_target_encode(spark, sf)


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f"WITH {_CUST} SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"c_mktsegment_{s}\"" for s in _SEGMENTS) + " FROM c")
def feat_onehot(spark, sf):
    step = features.OneHot(["c_mktsegment"], values={"c_mktsegment": list(_SEGMENTS)})
    return step.transform(_customers(spark, sf).select("c_custkey", "c_mktsegment"))


@query(f"WITH {_CUST}, q AS (SELECT quantile_cont(c_acctbal, 0.01) AS a, quantile_cont(c_acctbal, 0.99) AS b FROM c) SELECT c_custkey, round(CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal, a), b) END, 6) AS c_acctbal FROM c, q")
def feat_winsorize(spark, sf):
    return rounded(features.Winsorizer(["c_acctbal"]).fit_transform(_customers(spark, sf)).select("c_custkey", "c_acctbal"))


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS s_acctbal FROM supplier")
def feat_scale(spark, sf):
    return rounded(features.Scaler(("s_acctbal",)).fit_transform(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")))


@query("SELECT n_nationkey, n_name FROM nation")
def feat_nzv(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"))
    return features.NearZeroVariance().fit_transform(rows)


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size % 5 END::INTEGER AS char_bldg_sf, CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS ind_large, try_cast(substr(p_brand, 7) AS DOUBLE) AS ind_brand FROM part")
def feat_typeconv(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5).alias("char_bldg_sf"), (F.col("p_size") > 25).alias("ind_large"), F.substring("p_brand", 7, 9).alias("ind_brand"))
    return features.TypeConverter().fit_transform(rows)


@query("SELECT p_partkey, p_size, p_size + 0.001::DOUBLE AS p_size_1, p_size * p_size AS \"p_size^2\" FROM part")
def feat_poly(spark, sf):
    return features.PowerFeatures(shifted=["p_size"], squared=["p_size"]).fit_transform(table(spark, sf, "part").select("p_partkey", "p_size"))


@query()
def feat_boxcox(spark, sf):
    return features.PowerFeatures(box_cox=["p_retailprice"]).fit_transform(table(spark, sf, "part").select("p_partkey", "p_retailprice"))


@query("SELECT s_nationkey, s_acctbal FROM supplier")
def feat_pruner(spark, sf):
    return features.ColumnPruner(["s_acctbal", "s_nationkey", "absent"]).fit_transform(table(spark, sf, "supplier"))


@query()
def feat_linear_recipe(spark, sf):
    # The steps read the rows many times; parts and brands are sent out for the first.
    rows = staged(sales(spark, sf).select(F.log("sp").alias("y"), "quantity", "discount", "size", "brand", "kind"))
    recipe = features.linear_recipe("y", ["quantity", "discount", "size", "brand", "kind"], ["brand", "kind"], ["quantity", "discount", "size"], one_hot=["kind"], winsorized=["quantity"], shifted=["discount"], box_cox=["size"], squared=["quantity"])
    return recipe.fit_transform(rows)


@query()
def feat_cluster_labels(spark, sf):
    return features.cluster_labels(rows := table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), rows, ["p_size", "p_retailprice"], 4)[0]


# Models.


def _train(spark, sf, *more):
    return sales(spark, sf).select(F.log("sp").alias("y"), F.log("quantity").alias("x1"), (F.col("size") / 50).alias("x2"), "flag", *KEYS, *more)


_TRAIN = f"WITH {SALES}, t AS (SELECT ln(sp) AS y, ln(quantity) AS x1, size / 50 AS x2, flag FROM sales)"
_NORMAL = "n AS (SELECT var_pop(x1) AS a, covar_pop(x1, x2) AS b, var_pop(x2) AS c, covar_pop(x1, y) AS d, covar_pop(x2, y) AS e, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM t)"


def _coefficients(spark, model, digits=4):
    names = ["intercept", *(f"b_{f}" for f in model.features)]
    return spark.createDataFrame([tuple(round(float(v), digits) + 0.0 for v in (model.intercept, *model.beta))], ", ".join(f"{n} double" for n in names))


@query(f"{_TRAIN}, {_NORMAL}, s AS (SELECT (d * c - e * b) / (a * c - b * b) AS p, (a * e - b * d) / (a * c - b * b) AS q, * FROM n) SELECT round(my - p * m1 - q * m2, 4) AS intercept, round(p, 4) AS b_x1, round(q, 4) AS b_x2 FROM s")
def ols_fit(spark, sf):
    return _coefficients(spark, linear.least_squares(_train(spark, sf), ["x1", "x2"], "y"))


@query(f"{_TRAIN}, {_NORMAL}, s AS (SELECT (d * (c + 0.1) - e * b) / ((a + 0.1) * (c + 0.1) - b * b) AS p, ((a + 0.1) * e - b * d) / ((a + 0.1) * (c + 0.1) - b * b) AS q, * FROM n) SELECT round(my - p * m1 - q * m2, 4) AS intercept, round(p, 4) AS b_x1, round(q, 4) AS b_x2 FROM s")
def ridge_fit(spark, sf):
    return _coefficients(spark, linear.least_squares(_train(spark, sf), ["x1", "x2"], "y", l2=0.1))


@query(f"""{_TRAIN}, m AS (SELECT avg(y) AS my FROM t),
    s AS (SELECT avg(1 + 2 / (y * y)) AS a00, avg((1 + 2 / (y * y)) * x1) AS a01, avg((1 + 2 / (y * y)) * x1 * x1) + 0.01 AS a11, avg(y + 2 / y) AS b0, avg((y + 2 / y) * x1) AS b1, avg((y - my) / y) AS u0, avg((y - my) / y * x1) AS u1, avg((y - my) / y * y) AS f FROM t, m),
    k AS (SELECT a00 + 3 * u0 * u0 AS p, a01 + 3 * u0 * u1 AS q, a11 + 3 * u1 * u1 AS r, b0 + 3 * f * u0 AS v, b1 + 3 * f * u1 AS w FROM s)
    SELECT round((v * r - w * q) / (p * r - q * q), 4) AS intercept, round((p * w - q * v) / (p * r - q * q), 4) AS b_x1 FROM k""")
def ridge_cov_closed_form(spark, sf):
    return _coefficients(spark, linear.fair_ridge(_train(spark, sf), ["x1"], "y", alpha=0.01, rho_ratio=2.0, rho_cov=3.0))


@query()
def irls_prop(spark, sf):
    return _coefficients(spark, linear.least_proportional(_train(spark, sf), ["x1", "x2"], "y"))


@query()
def least_absolute_fit(spark, sf):
    return _coefficients(spark, linear.least_absolute(_train(spark, sf), ["x1"], "y"))


@query()
def least_absolute_certified(spark, sf):
    """Coefficients with the sum of absolute residuals and a dual value that no fit's sum is under."""
    fit = linear.least_absolute_exact(_train(spark, sf), ["x1", "x2"], "y")
    return _coefficients(spark, fit.model).withColumns({"primal": F.lit(round(fit.primal, 4)), "certified": F.lit(fit.primal - fit.dual <= 1e-7 * fit.primal)})


@query()
def poisson_fit(spark, sf):
    return _coefficients(spark, linear.glm(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), F.col("l_discount").alias("x1")), ["x1"], "y", "poisson"))


@query()
def logistic_fit(spark, sf):
    return _coefficients(spark, linear.glm(sales(spark, sf).select((F.col("sp") > 50000).cast("int").alias("y"), F.log("quantity").alias("x1")), ["x1"], "y", "logistic"))


@query()
def stable_tail_fit(spark, sf):
    return _coefficients(spark, linear.tail_mean(_train(spark, sf), ["x1"], "y", 0.5))


@query()
def stable_adversarial_fit(spark, sf):
    return _coefficients(spark, linear.stable_adversarial(_train(spark, sf), ["x1"], "y", 0.5, 1.0, 0.5))


@query()
def stable_two_tails_fit(spark, sf):
    return _coefficients(spark, linear.stable_adversarial_two(_train(spark, sf), ["x1"], "y", 0.5, 1.0))


@query()
def robust_ratio_fit(spark, sf):
    return _coefficients(spark, linear.robust_ratio(_train(spark, sf), ["x1"], "y", 0.5, 2.0))


@query()
def svm_fit(spark, sf):
    rows = sales(spark, sf).select((F.col("sp") > 50000).cast("int").alias("y"), F.log("quantity").alias("x1"))
    return _coefficients(spark, linear.glm(rows, ["x1"], "y", "svm", l2=0.01), 3)


@query()
def least_maximum_fit(spark, sf):
    return _coefficients(spark, linear.least_maximum(_train(spark, sf), ["x1"], "y"))


@query()
def max_deviation_fit(spark, sf):
    return _coefficients(spark, linear.max_deviation_constrained(_train(spark, sf), ["x1"], "y", 0.02))


@query()
def group_constrained_fit(spark, sf):
    model, _, reached = linear.group_bounded(_train(spark, sf), ["x1"], "y", "flag", 0.99)
    return _coefficients(spark, model).withColumn("reached", F.lit(round(reached, 3)))


@query()
def group_bounded_exact(spark, sf):
    """M19 with its certificate: each group's error against the limit, the multipliers, and the bound under the objective."""
    rows = []
    for share in (0.9999, 0.99):
        fit = bounded.bounded_fit(_train(spark, sf, "brand"), ["x1", "x2"], "y", "brand", share)
        rows += [(share, str(g), float(e), fit.limit, fit.multipliers[g], fit.feasible, fit.objective, fit.lower) for g, e in fit.errors.items()]
    return rounded(spark.createDataFrame(rows, "share double, grp string, error double, limit double, multiplier double, feasible boolean, objective double, lower double"), 5)


@query()
def fairness_price_exact(spark, sf):
    """Bounds on the price of a bound, and the price."""
    shares = (0.99999, 0.9999, 0.999)
    rows = [(s, *bounded.price_bounds(_train(spark, sf, "brand"), ["x1", "x2"], "y", "brand", s)) for s in shares]
    return rounded(spark.createDataFrame(rows, "share double, lower double, price double, upper double"), 6)


def _rows_at(spark, sf):
    rows = _train(spark, sf).withColumns({"f": 0.9 * F.col("y") + 1, "key": F.concat_ws("-", *KEYS)})
    return boosting.quantile_bins(staged(rows), "y", 4)


_AT = f"WITH {SALES}, t AS (SELECT concat_ws('-', k1, k2, k3, k4) AS key, ln(sp) AS y, 0.9 * ln(sp) + 1 AS f FROM sales), e AS (SELECT list_distinct(quantile_cont(y, [0.25, 0.5, 0.75])) AS e FROM t), w AS (SELECT t.*, len(list_filter(e, lambda v: v < y)) AS bin, f / y AS r, 1 / y AS dr FROM t, e)"
_KEPT = "SELECT key, round(CASE WHEN abs(g) < 1e-6 THEN 1e-6 ELSE g END, 5) AS g, round(greatest(h, 1e-6), 5) AS h FROM z"


@query(f"{_AT}, s AS (SELECT avg(y) AS m, avg(r * y) - avg(y) * avg(r) AS c, count(*) AS n FROM w), z AS (SELECT key, 2 * (f - y) + 50 * n * c * ((y - m) * dr / n) AS g, 2 + 50 * n * pow((y - m) * dr / n, 2) AS h FROM w, s) {_KEPT}")
def objective_grad_cov(spark, sf):
    return rounded(boosting.covariance_penalty(50.0)(_rows_at(spark, sf)).select("key", "g", "h"), 5)


@query(f"{_AT}, s AS (SELECT avg(y) AS m FROM w), z AS (SELECT key, 2 * (f - y) + 2 * 5 * (r - 1) * dr * pow(y - m, 2) AS g, 2 + 2 * 5 * dr * dr * pow(y - m, 2) AS h FROM w, s) {_KEPT}")
def objective_grad_smooth(spark, sf):
    return rounded(boosting.smooth_penalty(5.0)(_rows_at(spark, sf)).select("key", "g", "h"), 5)


@query(f"{_AT}, s AS (SELECT avg(r) AS m, count(*) AS n FROM w), b AS (SELECT bin, avg(r) AS mb, count(*) AS nb FROM w GROUP BY bin), z AS (SELECT key, 2 * (f - y) + 40 * (mb - m) * dr + 3 * (r - mb) * dr AS g, 2 + 40 * (1 / nb - 1 / n) * dr * dr + 3 * (1 - 1 / nb) * dr * dr AS h FROM w JOIN b USING (bin), s) {_KEPT}")
def objective_grad_bins(spark, sf):
    return rounded(boosting.bin_mean_penalty(40.0, within=3.0)(_rows_at(spark, sf)).select("key", "g", "h"), 5)


@query(f"{_AT}, b AS (SELECT bin, count(*) AS nb FROM w GROUP BY bin) SELECT bin AS target_bin, nb AS n, round((SELECT count(*) FROM w) / ((SELECT count(*) FROM b) * nb), 6) AS weight FROM b")
def binned_weights(spark, sf):
    rows = boosting.bin_weights(_rows_at(spark, sf))
    return rounded(rows.groupBy("target_bin").agg(F.count("*").alias("n"), F.first("weight").alias("weight")))


@query()
def primal_dual_step(spark, sf):
    rows = _rows_at(spark, sf)
    n = rows.count()
    out = boosting.primal_dual_weights(rows.withColumn("weight", F.lit(1.0 / n)), F.pow(F.col("f") - F.col("y"), 2), 2.0, 0.3)
    return out.select("key", "weight")


def _boosted(spark, sf, objective):
    rows = _train(spark, sf)
    model = boosting.boost(rows, ["x1", "x2"], "y", objective)
    return rounded(model.transform(rows).groupBy("flag").agg(F.count("*").alias("n"), r_squared("y", "prediction").alias("r2")), 4)


@query()
def gbm_smooth(spark, sf):
    return _boosted(spark, sf, boosting.smooth_penalty(1.0))


@query()
def gbm_cov(spark, sf):
    return _boosted(spark, sf, boosting.covariance_penalty(1.0))


@query()
def gbm_leafwise(spark, sf):
    """Numbers and categories, 31 leaves: rows and share of variance explained of an ensemble of 200 trees."""
    rows = _train(spark, sf, "brand", "kind", "discount")
    model = leafwise.boost_leafwise(rows, ["x1", "x2", "discount", "brand", "kind"], "y", boosting.squared_error(), leafwise.TreePlan(), categorical=["brand", "kind"])
    return rounded(model.transform(rows).groupBy("flag").agg(F.count("*").alias("n"), r_squared("y", "prediction").alias("r2")), 4)


@query()
def lp_stack(spark, sf):
    return rounded(stacking.optimise(runs(spark, sf), "fold_id", "config_id", "r2", {"prd": (1.0, 1.1)}), 6)


from ratiospark.plans import reports  # noqa: E402, F401  registers its queries
