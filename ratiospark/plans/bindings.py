"""The operators' roles bound to the given tables, as DataFrames and as common table expressions for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratiospark.sources.staging import staged

KEYS = ("k1", "k2", "k3", "k4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Line items as sales: price sp, assessed value av = half the price and half its brand's mean price.

    The brand's mean is an aggregate, made once and broadcast, one row a brand, so
    that rows are not gathered by brand and all passes see the same mean.  With
    ``keep``, line items and parts are joined once: the rows are staged with these
    columns, and the means and all that follows read them from there.
    """
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("l_shipdate").alias("d"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"), F.col("p_size").alias("size"), F.col("l_extendedprice").alias("sp"))
    if keep is not None:
        rows = staged(rows.select("brand", "sp", *(c for c in keep if c not in ("brand", "sp", "av"))))
    means = staged(rows.groupBy("brand").agg(F.avg("sp").alias("_mean")))
    return rows.join(F.broadcast(means), "brand").withColumn("av", 0.5 * F.col("sp") + 0.5 * F.col("_mean")).drop("_mean")


SALES = """sales AS (
    SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_returnflag AS flag, l_linestatus AS status, p_brand AS brand, p_type AS kind,
           l_shipdate AS d, l_discount AS discount, l_quantity AS quantity, p_size AS size, l_extendedprice AS sp,
           0.5 * l_extendedprice + 0.5 * avg(l_extendedprice) OVER (PARTITION BY p_brand) AS av
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
STUDY = (
    SALES
    + """, st AS (SELECT *, av / sp AS r FROM sales WHERE av > 0 AND sp > 0),
    med AS (SELECT flag, count(*) AS n, quantile_cont(r, 0.5) AS m FROM st GROUP BY flag),
    j AS (SELECT st.*, n, m, 0.5 * sp + 0.5 * av / m AS proxy FROM st JOIN med USING (flag))"""
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs: six configurations by fold (year), with means in the place of metrics."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.concat("l_returnflag", "l_linestatus").alias("config_id"), F.col("l_returnflag").alias("model_name"), (F.year("l_shipdate") - 1995).cast("long").alias("fold_id"), "l_discount", "l_tax", "l_quantity", "l_linenumber")
    return rows.groupBy("config_id", "model_name", "fold_id").agg(F.avg("l_discount").alias("r2"), (1 + F.avg("l_tax")).alias("prd"), (F.avg("l_discount") - F.avg("l_tax")).alias("prb"), F.avg("l_quantity").alias("vei"))


RUNS = """runs AS (
    SELECT l_returnflag || l_linestatus AS config_id, l_returnflag AS model_name, (year(l_shipdate) - 1995)::BIGINT AS fold_id,
           avg(l_discount) AS r2, 1 + avg(l_tax) AS prd, avg(l_discount) - avg(l_tax) AS prb, avg(l_quantity) AS vei
    FROM lineitem GROUP BY ALL)"""


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on a time axis."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")


def global_mean(df: DataFrame, column: str) -> DataFrame:
    """The table's mean of a column on each row, by a broadcast of one row."""
    return df.crossJoin(F.broadcast(df.agg(F.avg(column).alias("global_mean"))))


def rank_in(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(group).orderBy(order)))
