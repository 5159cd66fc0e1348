"""The training-data operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiospark.llm import decontamination, html_extraction, lexical_search, line_dedup, merkle, near_dedup, packing, pii, quality_model, quality_rules, sharding, token_counts, warc_revisits
from ratiospark.llm.tables import table


def op1_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve_revisits(warc_revisits.page_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.withColumn("headers", lines)


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.PackingPlan(tokenizer=public_tokenizers.path("word_bpe_49k.json")))


def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_rules.RiskPlan(wider=quality_rules.WIDER, slack=quality_rules.SLACK))


def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_texts(table(spark, sf_dir, "pages"))


def op9_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(pii.find_spans(table(spark, sf_dir, "documents"), pii.PiiPlan(everywhere=True, secrets=True, families=True)))


def op10_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, "doc_id", sharding.SHARDS).select("doc_id", "source", "n_chars", "slot", "shard")


def op11_variable_block_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_twin_filter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_level_store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    owners = ",".join(str(k) for k in sharding.fill_table(sharding.SHARDS))
    return f"""
        WITH placed AS (
            SELECT doc_id, source, n_chars,
                   ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS slot
            FROM documents),
        owners AS (SELECT string_split('{owners}', ',') AS o)
        SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(o[slot + 1], 3, '0') AS shard
        FROM placed, owners"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transducer_token_counts": op1_transducer_token_counts,
    "op2_revisit_resolution": op2_revisit_resolution,
    "op3_cost_balanced_packing": op3_cost_balanced_packing,
    "op4_tensored_minhash": op4_tensored_minhash,
    "op5_random_indexing_quality": op5_random_indexing_quality,
    "op6_risk_controlled_rules": op6_risk_controlled_rules,
    "op7_spaced_seed_decontamination": op7_spaced_seed_decontamination,
    "op8_main_text": op8_main_text,
    "op9_disclosure_pii": op9_disclosure_pii,
    "op10_lookup_sharding": op10_lookup_sharding,
    "op11_variable_block_wand": op11_variable_block_wand,
    "op12_twin_filter_lines": op12_twin_filter_lines,
    "op13_level_store_manifest": op13_level_store_manifest,
}


def oracle_sql() -> dict[str, str]:
    more = {"op11_variable_block_wand": lexical_search.RANK_SQL, "op12_twin_filter_lines": line_dedup.LINES_SQL, "op13_level_store_manifest": merkle.audit_sql()}
    return more | {"op2_revisit_resolution": warc_revisits.REVISITS_SQL, "op6_risk_controlled_rules": quality_rules.rules_sql(quality_rules.RiskPlan(wider=quality_rules.WIDER, slack=quality_rules.SLACK)), "op10_lookup_sharding": _op10_sql()}
