"""The registered queries of this subpackage, one for each operator, and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.llm import elias_fano, entropy_mix, hilbert_ann, katz_lm, near_dedup, phrase_index, suffix_dedup, toxicity, virtual_slots, warc_merge
from simgrove.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "component")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.fit_and_score(table(spark, sf_dir, "documents"))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.shard_documents(table(spark, sf_dir, "documents"))


def op6_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"))


def op7_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return elias_fano.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_merge.archive_pages(table(spark, sf_dir, "pages")).drop("span", "place")


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(table(spark, sf_dir, "documents")).drop("text_key", "source_key")


def op10_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_odd_sketch, op3_suffix_dedup, op4_katz, op5_virtual_slots, op6_hilbert_ann, op7_elias_fano, op8_warc_merge, op9_entropy_mix, op10_phrase_index)
}
ORACLE_SQL: dict[str, str] = {"op2_odd_sketch": near_dedup.ORACLE, "op6_hilbert_ann": hilbert_ann.ORACLE, "op8_warc_merge": warc_merge.ORACLE, "op10_phrase_index": phrase_index.ORACLE}
