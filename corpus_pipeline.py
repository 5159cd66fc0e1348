"""A training corpus from raw documents in five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiospark.llm import decontamination, near_dedup, packing, pii, quality_rules
from ratiospark.llm.tables import table
from ratiospark.llm.workspace import Workspace


#: A column, dropped again, that names a row where its id can't: ids may be null, or shared by rows.
ROW = "_pipeline_row"


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Drops the rejected rows, by ``ROW``, which is never null."""
    return docs.join(rejected.select(ROW).distinct(), ROW, "left_anti").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: a verdict depends on the language and the text.

    A null text or language counts as an empty one, and a text without 20 words is
    rejected; repeated rows, and rows that share an id or have none, are judged by
    what they hold; texts of any length are read whole.
    """
    plan = quality_rules.RiskPlan(wider=quality_rules.WIDER, slack=quality_rules.SLACK)
    lang, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "text"))
    named = docs.withColumn(ROW, F.md5(F.concat(F.length(lang).cast("string"), F.lit(":"), lang, text)))
    return _without(named, quality_rules.judge(named, table(spark, sf_dir, "labels"), plan, passed=(ROW,)).where("NOT kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the lowest id; a null id comes last.

    Of repeated rows one stays; rows without a word (null or empty texts) are like
    nothing and stay.
    """
    work = Workspace(spark)
    named = work.save(docs.withColumn(ROW, F.monotonically_increasing_id()))
    found = near_dedup.near_duplicates(named, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    found = work.save(found.join(named.select(ROW, "doc_id"), ROW))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("row")))
    groups = found.groupBy("component_id").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    rejected = work.save(found.join(groups, "component_id").where(F.col(ROW) != F.col("first.row")).select(ROW))
    work.keep(named, rejected)
    return _without(named, rejected)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap a benchmark item: a verdict depends on the text, of which 64 bits name it.

    Null and empty texts overlap nothing and stay; repeated rows go or stay together.
    """
    named = docs.withColumn(ROW, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = decontamination.overlaps(named, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return _without(named, found.withColumnRenamed("doc_id", ROW))


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, access tokens and terms that reveal them by tags; a group of near copies has one vote on a term.

    Every row stays; null texts stay null.
    """
    safe = pii.sanitise(pii.find_spans(docs, pii.PiiPlan(everywhere=True, secrets=True, families=True)), docs.columns)
    return safe.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else safe


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; a null or empty text is its end mark alone, repeated rows are packed each."""
    return packing.pack(docs, packing.PackingPlan(tokenizer=public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("pii", protect), ("packing", pack)]

#: Near-duplicate components and byte-pair tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes once the next is written.  An empty table gives an empty one."""
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir))
        work.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
