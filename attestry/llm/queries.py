"""The queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lookup, decision_lists, html_wrappers, mixing, sentencepiece_viterbi, sharding, simhash, token_files, toxicity, warc
from .common import read_table


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(read_table(spark, sf_dir, "pages"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode(read_table(spark, sf_dir, "documents")).drop("token_ids")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved_captures(read_table(spark, sf_dir, "pages"))


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lookup.fingerprints_and_edits(read_table(spark, sf_dir, "documents"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_lists.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("n_lines")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_wrappers, op2_hilbert_shards, op3_sentencepiece, op4_warc_revisits, op5_toxicity_chain, op6_source_mix, op7_simhash, op8_bloom_lookup, op9_decision_list, op10_token_files)}

ORACLE_SQL: dict[str, str] = {"op4_warc_revisits": warc.ORACLE_SQL, "op6_source_mix": mixing.ORACLE_SQL}
