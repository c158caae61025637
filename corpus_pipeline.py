"""From documents to shards: toxicity, near duplicates, benchmark contamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The labels and the benchmark come from sf_dir.

Defined results: a null or empty text is not toxic, near no other, not contaminated, has no words (rate 1) and size 8; rows without id are judged like others;
of rows that are equal in id and text near-deduplication keeps one; a null source is one source; very long texts are read whole; an empty table gives an empty one;
all columns of the input come along, whatever their names, through all stages but the last, which returns id, size, crc, shard and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.llm import entropy_mix, near_dedup, phrase_index, toxicity, virtual_slots
from simgrove.llm.common import broadcast_if_small, fresh, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of this corpus' labels calls toxic go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = phrase_index.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    found_id, found_key = fresh("found_id", docs), fresh("found_key", docs)
    found = stored(found.select(F.col("doc_id").alias(found_id), F.col("text_key").alias(found_key)).distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(F.col(found_id)) & (F.xxhash64(docs["text"]) == F.col(found_key))
    return docs.join(broadcast_if_small(found, found.count(), phrase_index.BROADCAST_ROWS), same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the entropy-balanced mix takes it."""
    return entropy_mix.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row."""
    return virtual_slots.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("sharding", assign_shards),
]

#: the first stage compresses with trained dictionaries, which SQL can't express; tests/llm compares each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
