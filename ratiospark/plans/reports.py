"""More queries of the catalogue: readers and writers, projections, joins, reports, recipes and iterative fits, each with its SQL.

Importing ``catalogue`` registers them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiospark.operators import dependence, features, flags, linear, ratio_study, summary
from ratiospark.operators.positions import with_position
from ratiospark.plans import experiment
from ratiospark.plans.bindings import RUNS, SALES, STUDY, ordered, runs, sales, table
from ratiospark.plans.catalogue import _BUNDLE, _CUST, _MEASURES, _TRAIN, _coefficients, _customers, _train, query, rounded
from ratiospark.sources import tables
from ratiospark.sources.staging import shared_path

# Sources and sinks.


@query(f"WITH {RUNS} SELECT fold_id, config_id, round(r2, 8) AS r2 FROM runs WHERE fold_id = 2")
def sink_partitioned_runs(spark, sf):
    """Appended below its layout, read with the partition pruned, beside a dataset that is not there yet."""
    root = shared_path(spark)
    done = runs(spark, sf).withColumns({"data_id": F.lit("d"), "split_id": F.lit("s")})
    tables.append_runs(done, f"{root}/runs")
    absent = tables.read_dataset(spark, f"{root}/absent", "fold_id long, config_id string, r2 double")
    back = tables.read_dataset(spark, f"{root}/runs").where("fold_id = 2").select(F.col("fold_id").cast("long").alias("fold_id"), "config_id", "r2")
    return rounded(back.unionByName(absent), 8)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def source_csv(spark, sf):
    """S5, S10."""
    path = f"{shared_path(spark)}/nations"
    tables.write_csv(table(spark, sf, "nation"), path)
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").where("n_regionkey = 2").select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region")
def source_json(spark, sf):
    """One document of many records."""
    path = f"{shared_path(spark)}/regions"
    rows = F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name")))
    table(spark, sf, "region").agg(F.to_json(rows).alias("value")).write.text(path)
    return tables.read_json(spark, path, "r_regionkey int, r_name string")


@query("SELECT run_id, status, error_type FROM (VALUES ('r1', 'completed', NULL), ('r2', 'failed', 'ZeroDivisionError'), ('r3', 'completed', NULL)) t(run_id, status, error_type)")
def status_capture(spark, sf):
    """The sweep goes on after a failure; the last status of each run."""
    log: list[dict] = []
    for name, below in (("r1", 1), ("r2", 0), ("r3", 2)):
        tables.guarded({"run_id": name}, lambda below=below: 1 / below, log.append)
    rows = [(k, r["run_id"], r["status"], r.get("error_type")) for k, r in enumerate(log)]
    found = spark.createDataFrame(rows, "timestamp_utc long, run_id string, status string, error_type string")
    last = tables.latest_status(found)
    return last.join(found.where("error_type IS NOT NULL").select("run_id", "error_type"), "run_id", "left")


@query(r"SELECT line FROM (SELECT '\begin{tabular}{ll}' AS line UNION ALL SELECT 'r\_regionkey & r\_name \\ \hline' UNION ALL SELECT r_regionkey || ' & ' || r_name || ' \\' FROM region UNION ALL SELECT '\end{tabular}')")
def report_latex(spark, sf):
    """S14."""
    rows = [r.asDict() for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]
    return spark.createDataFrame([(x,) for x in tables.latex_table(rows, ["r_regionkey", "r_name"]).split("\n")], "line string")


@query("SELECT rpad('r_regionkey', 11, ' ') || '  r_name' AS line UNION ALL SELECT rpad(r_regionkey::VARCHAR, 11, ' ') || '  ' || r_name FROM region")
def report_console(spark, sf):
    """S15."""
    rows = [r.asDict() for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]
    return spark.createDataFrame([(x,) for x in tables.console_table(rows, ["r_regionkey", "r_name"]).split("\n")], "line string")


# Projections and filters.


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL")
def project_columns(spark, sf):
    """The scan reads two columns."""
    return tables.read_table(spark, f"{sf}/part.parquet", ["p_brand", "p_size"]).groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate AS d FROM orders")
def cast_datetime(spark, sf):
    """From text; what is no date raises."""
    text = ordered(spark, sf).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return text.select("o_orderkey", F.to_timestamp("t", "yyyy-MM-dd HH:mm:ss").alias("d"))


@query("SELECT o_orderkey, round(ln(o_totalprice), 6) AS y, round(exp(ln(o_totalprice)), 2) AS price FROM orders WHERE o_totalprice > 0")
def log_and_back(spark, sf):
    """P7."""
    rows = ordered(spark, sf).where("o_totalprice > 0").withColumn("y", F.log("o_totalprice"))
    return rows.select("o_orderkey", F.round("y", 6).alias("y"), F.round(F.exp("y"), 2).alias("price"))


@query("SELECT p_partkey, p_size, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS price FROM part WHERE p_size % 3 <> 0 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22', 'Brand#33')")
def drop_null_and_member(spark, sf):
    """P9, P10."""
    rows = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("price"))
    return rows.na.drop(subset=["price"]).where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#21", "Brand#22", "Brand#33")).drop("p_brand")


@query(f"WITH {RUNS} SELECT config_id, fold_id, round(abs(prd - 1), 8) AS prd_dev, round(abs(prb), 8) AS prb_dev, round(abs(vei), 6) AS vei_dev, prd BETWEEN 1.0 AND 1.04 AS in_range, 'held' AS source FROM runs")
def deviations_tagged(spark, sf):
    """P14, P16, P21."""
    rows = summary.deviations(runs(spark, sf)).withColumns({"in_range": F.col("prd").between(1.0, 1.04), "source": F.lit("held")})
    return rows.select("config_id", "fold_id", F.round("prd_dev", 8).alias("prd_dev"), F.round("prb_dev", 8).alias("prb_dev"), F.round("vei_dev", 6).alias("vei_dev"), "in_range", "source")


@query(f"WITH {RUNS} SELECT config_id, round(avg(r2), 8) AS r2_mean, round(stddev_samp(r2), 8) AS r2_std FROM runs GROUP BY config_id")
def means_joined_by_name(spark, sf):
    """Two frames by configuration with their columns renamed, joined in full."""
    rows = runs(spark, sf)
    mean = rows.groupBy("config_id").agg(F.avg("r2").alias("r2")).withColumnsRenamed({"r2": "r2_mean"})
    std = rows.groupBy("config_id").agg(F.stddev_samp("r2").alias("r2")).withColumnsRenamed({"r2": "r2_std"})
    return rounded(mean.join(std, "config_id", "full"), 8)


@query("WITH w AS (SELECT p_brand, try_cast(CASE WHEN p_brand LIKE '%1' THEN 'none' ELSE substr(p_brand, 8) END AS DOUBLE) AS w FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_brand, round(w / (SELECT sum(w) FROM w WHERE w > 0), 8) AS weight FROM w WHERE w > 0")
def weights_coerced(spark, sf):
    """P13, P17."""
    text = F.when(F.col("p_brand").endswith("1"), "none").otherwise(F.substring("p_brand", 8, 9))
    return rounded(summary.positive_weights(table(spark, sf, "part").select("p_brand").distinct().withColumn("weight", text)), 8)


# Joins and orders.


@query(f"WITH {RUNS}, meta AS (SELECT config_id, fold_id, prd FROM runs WHERE fold_id <> 3) SELECT r.config_id, r.fold_id, round(r.r2, 8) AS r2, round(m.prd, 8) AS prd FROM runs r LEFT JOIN meta m USING (config_id, fold_id)")
def join_composite(spark, sf):
    """J2."""
    rows = runs(spark, sf)
    meta = rows.where("fold_id <> 3").select("config_id", "fold_id", "prd")
    return rounded(rows.select("config_id", "fold_id", "r2").join(meta, ["config_id", "fold_id"], "left"), 8)


@query("WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders) SELECT p.o_orderkey, q.o_orderkey AS next_key, round(q.o_totalprice - p.o_totalprice, 2) AS rise FROM p JOIN p q ON q.pos = p.pos + 1")
def join_by_position(spark, sf):
    """Rows aligned by their place in time."""
    placed = with_position(ordered(spark, sf), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_totalprice", "pos")
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("o_orderkey").alias("next_key"), F.col("o_totalprice").alias("next_price"))
    return placed.join(after, "pos").select("o_orderkey", "next_key", F.round(F.col("next_price") - F.col("o_totalprice"), 2).alias("rise"))


@query(f"{_TRAIN}, l AS (SELECT flag, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM t GROUP BY flag) SELECT flag, count(*) AS n, round(avg(a + b * x1), 5) AS mean_fit, round(avg(pow(y - a - b * x1, 2)), 5) AS mse FROM t JOIN l USING (flag) GROUP BY flag")
def cluster_routed_fit(spark, sf):
    """Each cluster predicted by its own model."""
    rows = _train(spark, sf).withColumn("cluster", F.col("flag"))
    out = experiment.cluster_routed(rows, rows, lambda df: linear.least_squares(df, ["x1"], "y"))
    return rounded(out.groupBy("flag").agg(F.count("*").alias("n"), F.avg("prediction").alias("mean_fit"), F.avg(F.pow(F.col("y") - F.col("prediction"), 2)).alias("mse")), 5)


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS pos FROM supplier) WHERE pos <= 25")
def sort_mixed(spark, sf):
    """T2, T8."""
    return table(spark, sf, "supplier").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey").limit(25).select("s_nationkey", "s_suppkey", "s_acctbal")


@query(f"WITH {SALES} SELECT k1, k2, k3, k4, round(abs(sp - av), 4) AS error FROM sales ORDER BY abs(sp - av) DESC, k1, k2, k3, k4 LIMIT 20")
def worst_rows(spark, sf):
    """A report of the K worst rows."""
    rows = sales(spark, sf).withColumn("error", F.abs(F.col("sp") - F.col("av")))
    return rounded(rows.orderBy(F.desc("error"), "k1", "k2", "k3", "k4").limit(20).select("k1", "k2", "k3", "k4", "error"), 4)


@query(f"WITH {RUNS}, t AS (SELECT config_id FROM runs GROUP BY config_id ORDER BY avg(r2) DESC, config_id LIMIT 3), h AS (SELECT * FROM runs WHERE config_id IN (SELECT config_id FROM t) AND NOT (config_id = (SELECT max(config_id) FROM t) AND fold_id = 1)) SELECT fold_id, config_id, round(r2, 8) AS r2 FROM h WHERE fold_id IN (SELECT fold_id FROM h GROUP BY fold_id HAVING count(*) = (SELECT count(DISTINCT config_id) FROM h)) AND config_id IN (SELECT config_id FROM h GROUP BY config_id HAVING count(*) = (SELECT count(DISTINCT fold_id) FROM h)) OR NOT EXISTS (SELECT 1 FROM h WHERE fold_id IN (SELECT fold_id FROM h GROUP BY fold_id HAVING count(*) = (SELECT count(DISTINCT config_id) FROM h)) AND config_id IN (SELECT config_id FROM h GROUP BY config_id HAVING count(*) = (SELECT count(DISTINCT fold_id) FROM h)))")
def topk_realigned(spark, sf):
    """T5: the best configurations, then the folds and configurations without a gap."""
    rows = runs(spark, sf)
    best = summary.top_configs(rows, "config_id", "r2", 3).select("config_id")
    last = best.agg(F.max("config_id").alias("last"))
    holed = rows.join(best, "config_id", "left_semi").crossJoin(F.broadcast(last)).where("NOT (config_id = last AND fold_id = 1)")
    return rounded(summary.complete_grid(holed, "fold_id", "config_id").select("fold_id", "config_id", "r2"), 8)


@query("SELECT c_mktsegment, round(count(*) / (SELECT count(*) FROM customer), 8) AS weight, (row_number() OVER (ORDER BY count(*) DESC, c_mktsegment))::INTEGER AS place FROM customer GROUP BY c_mktsegment")
def weight_listing(spark, sf):
    """Weights from the greatest down, with their place."""
    counts = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("weight"))
    listed = counts.agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "c_mktsegment"))).alias("rows"), F.sum("weight").alias("total"))
    return rounded(listed.select("total", F.posexplode("rows").alias("k", "r")).select("r.c_mktsegment", (-F.col("r.w") / F.col("total")).alias("weight"), (F.col("k") + 1).alias("place")), 8)


@query("SELECT p_partkey, round(p_retailprice / 100, 6) AS scaled, length(p_name)::INTEGER AS name_length, upper(p_brand) AS brand FROM part")
def columns_side_by_side(spark, sf):
    """New columns beside each other, by column expressions."""
    rows = table(spark, sf, "part")
    return rows.select("p_partkey").join(rows.select("p_partkey", (F.col("p_retailprice") / 100).alias("scaled"), F.length("p_name").alias("name_length"), F.upper("p_brand").alias("brand")), "p_partkey").withColumn("scaled", F.round("scaled", 6))


# Aggregates and reports.


@query(f"WITH {RUNS} SELECT model_name, round(avg(r2), 8) AS r2, round(avg(prd), 8) AS prd FROM runs GROUP BY model_name")
def overlay_means(spark, sf):
    """A36, V5."""
    return rounded(runs(spark, sf).groupBy("model_name").agg(F.avg("r2").alias("r2"), F.avg("prd").alias("prd")), 8)


@query(f"WITH {_CUST} SELECT count(DISTINCT c_mktsegment) + max(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) AS segments, count(DISTINCT c_nationkey) + max(CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END) AS nations FROM c")
def distinct_with_null(spark, sf):
    """A40."""
    many = lambda c: (F.count_distinct(c) + F.max(F.col(c).isNull().cast("long"))).alias
    return _customers(spark, sf).agg(many("c_mktsegment")("segments"), many("c_nationkey")("nations"))


@query(f"WITH {_CUST}, k AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM c WHERE c_mktsegment IS NOT NULL GROUP BY ALL) SELECT c_nationkey, c_mktsegment AS mode FROM k QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def mode_by_group(spark, sf):
    """The least of the most frequent values."""
    return _customers(spark, sf).where("c_mktsegment IS NOT NULL").groupBy("c_nationkey").agg(F.mode("c_mktsegment", True).alias("mode"))


@query("""WITH s AS (SELECT s_nationkey::DOUBLE AS x, s_acctbal AS y FROM supplier),
    b AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, greatest(4, floor(pow(count(*), 0.6) + 1e-9))::BIGINT AS most FROM s),
    g AS (SELECT i AS a, j AS b FROM b, range(2, 400) t(i), range(2, 400) u(j) WHERE i * j <= most),
    c AS (SELECT a, g.b, least(floor((x - x0) / (x1 - x0) * a), a - 1) AS i, least(floor((y - y0) / (y1 - y0) * g.b), g.b - 1) AS j, count(*) AS n FROM s, b, g GROUP BY ALL),
    p AS (SELECT a, b, i, sum(n) AS nx FROM c GROUP BY ALL), q AS (SELECT a, b, j, sum(n) AS ny FROM c GROUP BY ALL),
    m AS (SELECT a, b, sum(c.n / t.n * ln(c.n * t.n / (nx * ny))) / any_value(ln(least(c.a, c.b))) AS score FROM c JOIN p USING (a, b, i) JOIN q USING (a, b, j), (SELECT n FROM b) t GROUP BY c.a, c.b)
    SELECT round(max(score), 6) AS mic FROM m""")
def dependence_mic(spark, sf):
    """A48."""
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return spark.createDataFrame([(round(dependence.mic(rows, "x", "y"), 6),)], "mic double")


@query()
def dependence_rdc(spark, sf):
    """Random features, so without SQL."""
    rows = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return spark.createDataFrame([(dependence.rdc(rows, "x", "y"),)], "rdc double")


@query(f"WITH {RUNS}, m AS (SELECT config_id, avg(r2) AS a, avg(prd) AS b FROM runs GROUP BY config_id), f AS (SELECT a AS a0, b AS b0 FROM m WHERE config_id = 'AF') SELECT config_id, round((a - a0) / abs(a0), 8) AS accuracy_change, round((b - b0) / abs(b0), 8) AS prd_change FROM m, f")
def fairness_price(spark, sf):
    """A51."""
    means = runs(spark, sf).groupBy("config_id").agg(F.avg("r2").alias("a"), F.avg("prd").alias("b"))
    base = means.where("config_id = 'AF'").select(F.col("a").alias("a0"), F.col("b").alias("b0"))
    both = means.crossJoin(F.broadcast(base))
    return rounded(both.select("config_id", summary.effective_improvement(F.col("a0"), F.col("a")).alias("accuracy_change"), summary.effective_improvement(F.col("b0"), F.col("b")).alias("prd_change")), 8)


@query("SELECT config_id, CASE WHEN keep IS NULL THEN 'Boosting(rho=' || rho || ')' ELSE 'Boosting(rho=' || rho || ', keep=' || keep || ')' END AS label FROM (VALUES ('c0', '0.1', NULL), ('c1', '0.3', '0.5'), ('c2', '1.0', NULL)) t(config_id, rho, keep)")
def model_labels(spark, sf):
    """F10."""
    from ratiospark.functions.ids import model_label

    configs = {"c0": {"rho": 0.1, "seed": 1}, "c1": {"keep": 0.5, "rho": 0.3}, "c2": {"rho": 1.0}}
    return spark.createDataFrame([(k, model_label("Boosting", c)) for k, c in configs.items()], "config_id string, label string")


_AFTER_SALES = STUDY[len(SALES) :]
_HELD = f"""WITH {SALES.replace('sales AS', 'base AS', 1)}, fit AS (SELECT regr_slope(ln(sp), ln(quantity)) AS b, regr_intercept(ln(sp), ln(quantity)) AS a FROM base WHERE d < TIMESTAMP '2000-01-01'),
    sales AS (SELECT k1, k2, k3, k4, 'LinearRegression' AS flag, sp, exp(a + b * ln(quantity)) AS av FROM base, fit WHERE d >= TIMESTAMP '2000-01-01' AND d < TIMESTAMP '2001-01-01')"""
_HELD_BUNDLE = _BUNDLE.replace(f"WITH {STUDY}", _HELD + _AFTER_SALES, 1)


@query(f"{_HELD_BUNDLE} SELECT flag AS model_name, n, {', '.join(f'round({c}, 5) AS {c}' for c in _MEASURES)} FROM bundle")
def held_out_report(spark, sf):
    """A model fitted on the years before, measured once on the next one."""
    from ratiospark.operators import folds

    rows = sales(spark, sf).withColumn("x1", F.log("quantity"))
    before, year = folds.year_split(rows, "d", 2000)
    spec = experiment.Spec("LinearRegression", {}, lambda df: linear.least_squares(df, ["x1"], "y"))
    p = experiment.Protocol(date="d", price="sp", key=("k1", "k2", "k3", "k4"), features=["x1"])
    return rounded(experiment.held_out(before, year, [spec], p).select("model_name", "n", *_MEASURES), 5)


@query(f"WITH {STUDY}, l AS (SELECT flag, unnest(['ratio', 'log_ratio', 'residual', 'log_residual']) AS y, unnest([av / sp, ln(av) - ln(sp), av - sp, ln(sp) - ln(av)]) AS v, sp FROM st) SELECT flag, y, round(1000 * regr_slope(v, sp), 5) AS slope, round(regr_intercept(v, sp), 4) AS intercept FROM l GROUP BY ALL")
def scatter_lines(spark, sf):
    """V7: trend lines of the plot tables, by cluster."""
    lines = experiment.scatter_tables(sales(spark, sf).select("flag", "sp", "av"), "flag")[1]
    return lines.select("flag", "y", F.round(1000 * F.col("slope"), 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"WITH {RUNS}, v AS (SELECT model_name, fold_id / 10 AS rho, r2, prd FROM runs), l AS (SELECT model_name, rho, unnest(['r2', 'prd']) AS metric, unnest([r2, prd]) AS x FROM v) SELECT model_name, rho, metric, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS std FROM l GROUP BY ALL")
def parameter_curves(spark, sf):
    """V8, V9: metrics along a parameter of the configuration."""
    rows = runs(spark, sf).withColumn("model_config_json", F.to_json(F.struct((F.col("fold_id") / 10).alias("rho"))))
    return rounded(experiment.parameter_series(rows, "rho", ("r2", "prd")), 8)


@query(f"WITH {RUNS}, w(config_id, weight) AS (VALUES ('AF', 0.5), ('NO', 0.3), ('RF', 0.2)), e AS (SELECT fold_id % 3 AS fold, fold_id, sum(weight * r2) AS v FROM runs JOIN w USING (config_id) GROUP BY ALL) SELECT fold, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS std FROM e GROUP BY fold")
def ensemble_evolution(spark, sf):
    """Weighted sums by fold and draw, then their mean and deviation by fold."""
    weights = spark.createDataFrame([("AF", 0.5), ("NO", 0.3), ("RF", 0.2)], "config_id string, weight double")
    by_draw = summary.linear_ensemble(runs(spark, sf), weights, "fold_id", "config_id", ("r2",))
    return rounded(by_draw.groupBy((F.col("fold_id") % 3).alias("fold")).agg(F.avg("r2_ensemble").alias("mean"), F.stddev_samp("r2_ensemble").alias("std")), 8)


@query(f"WITH {STUDY}, p AS (SELECT brand, avg(r) / (sum(av) / sum(sp)) AS prd FROM st GROUP BY brand) SELECT brand, 'PRD ' || CASE WHEN prd > {flags.PRD[1]} THEN 'regressive' WHEN prd < {flags.PRD[0]} THEN 'progressive' ELSE 'neutral' END || '; PRB undefined; VEI undefined' AS reading FROM p")
def flags_reading(spark, sf):
    """F6, and how it reads what is undefined."""
    p = ratio_study.accuracy(sales(spark, sf), ["brand"], only=("prd",))
    none = F.lit(None).cast("double")
    return p.select("brand", flags.interpretation(F.col("prd"), none, none).alias("reading"))


@query(f"WITH {STUDY}, bad AS (SELECT flag, CASE WHEN k2 = 7 AND flag = 'R' THEN NULL ELSE r END AS r FROM st) SELECT flag, CASE WHEN count(*) = count(r) THEN round(avg(r), 6) END AS mean_ratio FROM bad GROUP BY flag")
def incomplete_is_null(spark, sf):
    """One missing value makes the group's measure undefined."""
    rows = sales(spark, sf).where("av > 0 AND sp > 0").withColumn("r", F.when(~((F.col("k2") == 7) & (F.col("flag") == "R")), F.col("av") / F.col("sp")))
    return rounded(rows.groupBy("flag").agg(ratio_study.nan_if_incomplete(F.avg("r"), "r").alias("mean_ratio")))


# Recipes.


_RECIPE_ROWS = f"{_CUST}, r AS (SELECT c_custkey, ln(20000 + coalesce(c_acctbal, 0)) AS y, c_acctbal, c_mktsegment FROM c), k AS (SELECT DISTINCT c_mktsegment AS v FROM r WHERE c_mktsegment <> 'BUILDING')"
_CODED = "CASE WHEN c_mktsegment IS NULL THEN 'unknown' WHEN v IS NULL THEN 'new' ELSE v END AS c_mktsegment"


def _recipe_rows(spark, sf):
    return _customers(spark, sf).select("c_custkey", F.log(20000 + F.coalesce("c_acctbal", F.lit(0))).alias("y"), "c_acctbal", "c_mktsegment", F.lit("x").alias("time_split"))


def _main_recipe(spark, sf, numeric):
    rows = _recipe_rows(spark, sf)
    recipe = features.main_recipe("y", ["c_acctbal", "c_mktsegment"], ["c_mktsegment"], ["c_custkey"], numeric)
    return rounded(recipe.fit(rows.where("c_mktsegment <> 'BUILDING'")).transform(rows))


@query(f"WITH {_RECIPE_ROWS} SELECT c_custkey, round(y, 6) AS y, round(c_acctbal, 6) AS c_acctbal, {_CODED} FROM r LEFT JOIN k ON v = c_mktsegment")
def recipe_main(spark, sf):
    """E14."""
    return _main_recipe(spark, sf, [])


@query(f"WITH {_RECIPE_ROWS}, m AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM r WHERE c_mktsegment <> 'BUILDING') SELECT c_custkey, round(y, 6) AS y, round(coalesce(c_acctbal, m), 6) AS c_acctbal, {_CODED} FROM m, r LEFT JOIN k ON v = c_mktsegment")
def recipe_main_imputed(spark, sf):
    """E15."""
    return _main_recipe(spark, sf, ["c_acctbal"])


def _linear_recipe(spark, sf, target_encoding):
    rows = _customers(spark, sf).select(F.col("c_custkey").cast("double").alias("key"), F.log(20000 + F.coalesce("c_acctbal", F.lit(0))).alias("y"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return features.linear_recipe("y", ["key", "balance", "segment", "nation"], ["segment", "nation"], ["balance"], one_hot=["segment"], winsorized=["balance"], shifted=["balance"], squared=["balance"], scaled=("balance", "nation"), target_encoding=target_encoding).fit_transform(rows)


_LINEAR = f"""WITH {_CUST}, a AS (SELECT c_custkey::DOUBLE AS key, ln(20000 + coalesce(c_acctbal, 0)) AS y, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM c),
    s AS (SELECT quantile_cont(balance, 0.5) AS m FROM a), o AS (SELECT segment AS top FROM a WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    i AS (SELECT key, y, coalesce(balance, m) AS balance, coalesce(segment, top) AS segment, nation FROM a, s, o),
    e AS (SELECT i.*, avg(y) OVER (PARTITION BY nation) AS encoded FROM i),
    q AS (SELECT quantile_cont(balance, 0.01) AS lo, quantile_cont(balance, 0.99) AS hi FROM e),
    w AS (SELECT key, y, least(greatest(balance, lo), hi) AS balance, segment, nation, encoded FROM e, q),
    z AS (SELECT *, balance + 0.001 AS b1, balance * balance AS b2 FROM w)
    SELECT key, round(y, 5) AS y, round((balance - avg(balance) OVER ()) / stddev_pop(balance) OVER (), 5) AS balance, NATION AS nation,
           """ + ", ".join(f"CASE WHEN segment = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"segment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + """,
           round((b1 - avg(b1) OVER ()) / stddev_pop(b1) OVER (), 5) AS balance_1, round((b2 - avg(b2) OVER ()) / stddev_pop(b2) OVER (), 5) AS "balance^2" FROM z"""


@query(_LINEAR.replace("NATION AS nation", "round((encoded - avg(encoded) OVER ()) / stddev_pop(encoded) OVER (), 5) AS nation"))
def recipe_linear(spark, sf):
    """E16."""
    return rounded(_linear_recipe(spark, sf, True), 5)


@query(_LINEAR.replace("NATION AS nation", "nation"))
def recipe_without_encoding(spark, sf):
    """E17."""
    return rounded(_linear_recipe(spark, sf, False), 5)


# Iterative fits: the same steps in recursive SQL.


def fit_sql(rows: str, start: str, weight: str, steps: int, tol: float, response: str = "y", moved: str = "") -> str:
    """Reweighted least squares of y on x1 in recursive SQL: ``start`` gives (a, b), ``weight`` and ``response`` are of y, x1, a and b."""
    return f"""WITH RECURSIVE {rows},
        it(k, a, b, moved) AS (
            SELECT 0, a::DOUBLE, b::DOUBLE, 1e9::DOUBLE FROM ({start})
            UNION ALL
            SELECT k + 1, my - slope * mx, slope, greatest(abs(my - slope * mx - a), abs(slope - b))
            FROM (SELECT k, a, b, sum(w * x1) / sum(w) AS mx, sum(w * v) / sum(w) AS my, (sum(w * x1 * v) / sum(w) - sum(w * x1) / sum(w) * sum(w * v) / sum(w)) / (sum(w * x1 * x1) / sum(w) - pow(sum(w * x1) / sum(w), 2)) AS slope
                  FROM (SELECT it.k, it.a, it.b, t.x1, {weight} AS w, {response} AS v FROM it, t WHERE it.moved >= {tol} AND it.k < {steps}) GROUP BY k, a, b))
        SELECT round(a, 4) AS intercept, round(b, 4) AS b_x1 FROM it ORDER BY k DESC LIMIT 1"""


_T1 = _TRAIN.removeprefix("WITH ")
_OLS1 = "SELECT regr_intercept(y, x1) AS a, regr_slope(y, x1) AS b FROM t"


@query(fit_sql(_T1, _OLS1, "1 / greatest(abs(y - a - b * x1), 1e-4)", 50, 1e-6))
def least_absolute_steps(spark, sf):
    """M12."""
    return _coefficients(spark, linear.least_absolute(_train(spark, sf), ["x1"], "y"))


@query(fit_sql(_T1, _OLS1, "1 / (pow(y - a - b * x1, 2) + 1)", 99, 1e-4))
def least_proportional_steps(spark, sf):
    """M22."""
    return _coefficients(spark, linear.least_proportional(_train(spark, sf), ["x1"], "y"))


_COUNTS = "t AS (SELECT l_quantity AS y, l_discount AS x1 FROM lineitem)"


@query(fit_sql(_COUNTS, "SELECT ln(avg(y)) AS a, 0.0 AS b FROM t", "exp(a + b * x1)", 30, 1e-8, "a + b * x1 + (y - exp(a + b * x1)) / exp(a + b * x1)"))
def poisson_steps(spark, sf):
    """Poisson."""
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), F.col("l_discount").alias("x1"))
    return _coefficients(spark, linear.glm(rows, ["x1"], "y", "poisson"))


_YES = f"{SALES}, t AS (SELECT CASE WHEN sp > 50000 THEN 1 ELSE 0 END AS y, quantity / 50 AS x1 FROM sales)"
_MU = "(1 / (1 + exp(-(a + b * x1))))"


@query(fit_sql(_YES, "SELECT 0.0 AS a, 0.0 AS b", f"greatest({_MU} * (1 - {_MU}), 1e-9)", 30, 1e-8, f"a + b * x1 + (y - {_MU}) / greatest({_MU} * (1 - {_MU}), 1e-9)"))
def logistic_steps(spark, sf):
    """Logistic."""
    rows = sales(spark, sf).select((F.col("sp") > 50000).cast("int").alias("y"), (F.col("quantity") / 50).alias("x1"))
    return _coefficients(spark, linear.glm(rows, ["x1"], "y", "logistic"))
