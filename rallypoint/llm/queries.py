"""One query per text operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from rallypoint.llm import brown_lm, decontaminate, filter_audit, html_cut, packing, preference, quality_rules, secret_scan, simhash, sql, token_counts, token_files, vector_codes, warc
from rallypoint.llm.common import ready, table


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(ready(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return preference.format_pairs(turns, preference.replies_from_next(turns), "conv_id")


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    return quality_rules.score_hosts(docs).drop("rules_failed", "host_rate")


def op3_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_near(table(ready(spark), sf_dir, "documents"))


def op4_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(ready(spark), sf_dir, "documents"))


def op5_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(ready(spark), sf_dir, "pages"))


def op6_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(ready(spark), sf_dir, "documents"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(ready(spark), sf_dir, "documents"))


def op8_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(ready(spark), table(spark, sf_dir, "pages"))


def op9_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(ready(spark), sf_dir, "documents"))


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks_and_members(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(ready(spark), sf_dir, "embeddings")).drop("label")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_perfect_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(ready(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preference_pairs": op1_preference_pairs,
    "op2_host_rules": op2_host_rules,
    "op3_simhash_variants": op3_simhash_variants,
    "op4_brown_classes": op4_brown_classes,
    "op5_minimum_cut": op5_minimum_cut,
    "op6_secret_automaton": op6_secret_automaton,
    "op7_best_fit": op7_best_fit,
    "op8_capture_index": op8_capture_index,
    "op9_trie_counts": op9_trie_counts,
    "op10_template_windows": op10_template_windows,
    "op11_filtering_lloyd": op11_filtering_lloyd,
    "op12_filter_audit": op12_filter_audit,
    "op13_perfect_hash_shards": op13_perfect_hash_shards,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_preference_pairs": sql.OP1,
    "op2_host_rules": sql.OP2,
    "op8_capture_index": sql.OP8,
    "op10_template_windows": sql.OP10,
    "op11_filtering_lloyd": sql.OP11,
    "op12_filter_audit": sql.OP12,
}
