"""Sharding by fixed virtual slots.

Records hash by id into thousands of slots whose number never changes. Bytes are summed for each slot, and a versioned table maps
slots to shards. Rebalancing edits the map: a new version differs from the last one only in the slots that move. The law that
holds is `bytes`: shards hold nearly equal bytes.

Under this law a record's slot comes from its id, text and size, so that null or repeated ids spread over the slots like others. Equal texts are not kept
together: a group of copies, even of a third of all rows, goes over all shards by its ids.

Defined results: a null text has size 8 and the crc of no bytes; null and repeated ids are told apart by their texts; rows equal in id and text share a slot, side by side;
a very long text makes its slot as heavy as it is, and other slots of its shard fewer; an empty table gives an empty result and a map all the same; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS, SHARDS = 4096, 24


def records(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sizes(recs: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows): at most as many as there are slots, a fixed number, so the driver may hold them."""
    rows = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r[0], int(r[1]), r[2]) for r in rows)


def first_map(sizes: list[tuple[int, int, int]], slots: int, shards: int) -> dict[int, int]:
    """Version 1: the largest slots first, each to the shard with the fewest bytes; ties to the smaller shard."""
    bytes_of = {s: b for s, b, _ in sizes}
    heap, out = [(0, k) for k in range(shards)], {}
    for s in sorted(range(slots), key=lambda s: (-bytes_of.get(s, 0), s)):
        have, k = heapq.heappop(heap)
        out[s] = k
        heapq.heappush(heap, (have + bytes_of.get(s, 0), k))
    return out


def rebalance(current: dict[int, int], sizes: list[tuple[int, int, int]], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The next version: slots move from the fullest shard to the emptiest while that lessens their difference. New shards start empty."""
    bytes_of = {s: b for s, b, _ in sizes}
    out = {s: k for s, k in current.items() if k < shards}
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for s, k in out.items():
        load[k] += bytes_of.get(s, 0)
        held[k].append(s)
    for s in sorted((s for s in current if s not in out), key=lambda s: (-bytes_of.get(s, 0), s)):  # shards that go
        k = min(range(shards), key=lambda k: (load[k], k))
        out[s], load[k] = k, load[k] + bytes_of.get(s, 0)
        held[k].append(s)
    mean = sum(load) / max(1, shards)
    for _ in range(len(current)):
        hi, lo = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[hi] - load[lo]
        movable = [s for s in held[hi] if 0 < bytes_of.get(s, 0) < gap]
        if load[hi] <= mean * (1 + tolerance) and load[lo] >= mean * (1 - tolerance) or not movable:
            break
        s = min(movable, key=lambda s: (abs(gap - 2 * bytes_of[s]), s))
        held[hi].remove(s)
        held[lo].append(s)
        out[s], load[hi], load[lo] = lo, load[hi] - bytes_of[s], load[lo] + bytes_of[s]
    return out


def map_frame(spark, versions: list[dict[int, int]]) -> DataFrame:
    """The versioned table: version, virtual_slot, shard; later versions hold only what they edit."""
    rows, last = [], {}
    for v, m in enumerate(versions, 1):
        rows += [(v, s, k) for s, k in sorted(m.items()) if last.get(s) != k]
        last = m
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")


def map_at(versions: DataFrame, version: int) -> DataFrame:
    """The slot map as it is at a version."""
    return versions.filter(F.col("version") <= version).groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def store_map(spark, versions: list[dict[int, int]], path: str) -> DataFrame:
    """Writes the versioned table; a later version is one more folder, so that old ones stay readable."""
    f = map_frame(spark, versions)
    f.write.mode("overwrite").partitionBy("version").parquet(path)
    return spark.read.schema(f.schema).parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard (null: the law is bytes), virtual_slot, map_version.

    path: where the slot map is stored (the shared folder if not given).
    """
    from simgrove.llm.common import scratch_path

    spark = docs.sparkSession
    recs = records(docs, slots, doc_id, text)
    sizes = slot_sizes(recs)
    versions = [first_map(sizes, slots, shards)]
    edited = rebalance(versions[0], sizes, shards)
    if edited != versions[0]:
        versions.append(edited)
    stored_map = store_map(spark, versions, path or scratch_path(spark, "slot_map"))
    shard_of = {r[0]: r[1] for r in map_at(stored_map, len(versions)).collect()}  # one row a slot
    before, seen = [], [0] * shards
    for s, _, n in sizes:
        k = shard_of[s]
        before.append((s, k, seen[k]))
        seen[k] += n
    at = F.broadcast(spark.createDataFrame(before, "virtual_slot int, shard int, slot_before long"))  # at most one row a slot
    order = W.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    out = recs.withColumn("in_slot", F.row_number().over(order)).join(at, "virtual_slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot_before") + F.col("in_slot") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(len(versions)).alias("map_version"),
    )
