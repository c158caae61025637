"""Dataset curation: media records, sampling, manifests, checksums, and validation as tables of findings."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simgrove.functions.text import filled, normalize_license
from simgrove.operators.similarity import BLOCK, on_block_pairs


def media_filter(records: DataFrame, key: str, media: str, allowed: list[str]) -> DataFrame:
    """Still images with a web identifier and an allowed licence, each identifier once for each record, in order. key, place, identifier, license, normalized_license, creator, rights_holder, publisher, references."""
    m = records.select(F.col(key).alias("key"), F.posexplode(media).alias("place", "m"))
    m = m.filter((F.col("m.type") == "StillImage") & F.col("m.identifier").rlike("^https?://"))
    m = m.withColumn("normalized_license", normalize_license(F.col("m.license"))).filter(F.col("normalized_license").isin(allowed))
    m = m.withColumn("n", F.row_number().over(W.partitionBy("key", "m.identifier").orderBy("place"))).filter("n = 1")
    return m.select("key", "place", "m.identifier", "m.license", "normalized_license", "m.creator", F.col("m.rightsHolder").alias("rights_holder"), "m.publisher", "m.references")


def rights_metadata(occurrences: DataFrame, media: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rights of each wanted (key, identifier): the first media entry with the identifier, falling back to the occurrence's own values.

    occurrences: key, license, rights, rights_holder; media: key, place, identifier, license, rights, rights_holder, creator.
    """
    first = media.groupBy("key", "identifier").agg(F.min_by(F.struct("license", "rights", "rights_holder", "creator"), "place").alias("m"))
    j = wanted.join(occurrences, "key", "left").join(first, ["key", "identifier"], "left")
    pick = lambda c: F.coalesce(F.nullif(F.col(f"m.{c}"), F.lit("")), F.col(c), F.lit("")).alias(c)
    return j.select("key", "identifier", pick("license"), pick("rights"), pick("rights_holder"), F.coalesce(F.col("m.creator"), F.lit("")).alias("creator"))


def round_robin_sample(pool: DataFrame, stratum: str, order: list[str], target: int, valid=None, strict: bool = True) -> DataFrame:
    """One valid candidate of each stratum a round, strata in the order of their names, until target: adds sample_index. With strict, a pool with fewer valid rows than target is an error, raised when the result is read."""
    p = pool if valid is None else pool.filter(valid)
    p = p.withColumn("round", F.row_number().over(W.partitionBy(stratum).orderBy(*order)))
    top = p.filter(F.col("round") <= target).orderBy("round", stratum).limit(target)
    everything = W.partitionBy()  # target rows at most
    number = (F.row_number().over(everything.orderBy("round", stratum)) - 1).cast("long")
    if not strict:
        return top.withColumn("sample_index", number)
    n = F.count(F.lit(1)).over(everything)
    whole = F.when(n < target, F.raise_error(F.concat(F.lit(f"the pool has fewer than {target} valid rows: "), n.cast("string"))).cast("long"))
    return top.withColumn("sample_index", F.coalesce(whole, number))


def pool_cap(pool: DataFrame, stratum: str, key: str, arrival: list[str], cap: int) -> DataFrame:
    """The first `cap` rows of each stratum by arrival, each key once, with place."""
    first = pool.withColumn("k_", F.row_number().over(W.partitionBy(stratum, key).orderBy(*arrival))).filter("k_ = 1").drop("k_")
    return first.withColumn("place", F.row_number().over(W.partitionBy(stratum).orderBy(*arrival)).cast("long")).filter(F.col("place") <= cap)


def exact_dedup(docs: DataFrame, content: str, key: str) -> DataFrame:
    """The row with the smallest key for each distinct content (by SHA-256)."""
    d = docs.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    return d.groupBy("sha256").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validate_matrix(pairs_both: DataFrame) -> DataFrame:
    """Findings on square matrices given as all cells (layer, i, j, similarity): rule, severity, n_bad; rules without findings have 0."""
    c = pairs_both
    sizes = c.groupBy("layer").agg(F.countDistinct("i").alias("rows"), F.countDistinct("j").alias("cols"), F.count(F.lit(1)).alias("cells"))
    t = c.select("layer", F.col("j").alias("i"), F.col("i").alias("j"), F.col("similarity").alias("other"))
    a = c.join(t, ["layer", "i", "j"], "left").groupBy("layer").agg(
        F.count(F.when((F.col("i") == F.col("j")) & (F.abs(F.col("similarity") - 1) > 1e-6), 1)).alias("diagonal"),
        F.count(F.when((F.col("i") < F.col("j")) & ~(F.abs(F.col("similarity") - F.col("other")) <= 1e-6), 1)).alias("symmetry"),
        F.count(F.when(F.abs("similarity") > 1.1, 1)).alias("range"),
    )
    return _matrix_findings(sizes.join(a, "layer"))


def _matrix_findings(s: DataFrame) -> DataFrame:
    """The rules on layer, rows, cols, cells, diagonal, symmetry, range."""

    def found(rule: str, severity: str, n: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), n.cast("long").alias("n_bad"))

    odd = (F.col("rows") != F.col("cols")) | (F.col("cells") != F.col("rows") * F.col("cols"))
    rules = F.array(
        found("square", "error", F.when(odd, 1).otherwise(0)), found("two_samples", "error", F.when(F.col("rows") < 2, 1).otherwise(0)),
        found("diagonal", "warning", F.col("diagonal")), found("symmetry", "warning", F.col("symmetry")), found("range", "warning", F.col("range")),
    )
    return s.select("layer", F.inline(rules))


def validate_matrix_of(features: DataFrame, planted: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, block: int = BLOCK) -> DataFrame:
    """validate_matrix of the features' own similarity matrix, its cells made and judged block by block: tasks return counts, and no cell is shuffled.

    planted: gives of rows i, columns j and similarities the values of the cells, and which cells are there.
    """
    cell = planted or (lambda i, j, s: (s, np.ones(s.shape, bool)))

    def kernel(ids: np.ndarray, jds: np.ndarray, s: np.ndarray) -> tuple:
        same = len(ids) == len(jds) and (ids == jds).all()
        i, j = np.broadcast_to(ids[:, None], s.shape), np.broadcast_to(jds[None, :], s.shape)
        pair = s > -np.inf
        (down, has), (up, back) = cell(i, j, s), cell(j, i, s)
        has, back = has & pair, back & pair
        off = lambda x: ~(np.abs(x) <= 1.1)  # noqa: E731  NaN counts
        out = {"cells": has.sum() + back.sum(), "range": (off(down) & has).sum() + (off(up) & back).sum(), "symmetry": (~(np.abs(down - up) <= 1e-6) & has & back).sum(), "diagonal": 0, "blocks": 0}
        row, col = [has.any(axis=1), back.any(axis=0)], [back.any(axis=1), has.any(axis=0)]  # of ids as rows, jds as rows; of ids and jds as columns
        if same:
            d, own = cell(ids, ids, np.ones(len(ids)))
            out |= {"cells": out["cells"] + own.sum(), "range": out["range"] + (off(d) & own).sum(), "diagonal": ((~(np.abs(d - 1) <= 1e-6)) & own).sum(), "blocks": 1}
            row, col = [row[0] | row[1] | own], [col[0] | col[1] | own]
        names, counts, samples = list(out), list(out.values()), [-1] * len(out)
        for kind, sides in (("no row", row), ("no column", col)):
            for k, at in zip((ids, jds), sides):
                samples += k[~at].tolist()
        names += ["no row"] * sum(int((~x).sum()) for x in row) + ["no column"] * sum(int((~x).sum()) for x in col)
        return names, samples, counts + [1] * (len(names) - len(counts))

    # a sample meets every block once; it has no row if it has none in any of them
    c = on_block_pairs(features, kernel, "layer string, kind string, sample_id long, n long", block=block)
    c = c.groupBy("layer", "kind", "sample_id").agg(F.sum("n").alias("n"))
    blocks = c.filter("kind = 'blocks'").select("layer", F.col("n").alias("blocks"))
    c = c.join(F.broadcast(blocks), "layer")
    gone = lambda kind: F.count(F.when((F.col("kind") == kind) & (F.col("n") == F.col("blocks")), 1))
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    s = c.groupBy("layer").agg(gone("no row").alias("no_row"), gone("no column").alias("no_col"), *[count(k).alias(k) for k in ("cells", "diagonal", "symmetry", "range")])
    s = s.join(features.groupBy("layer").agg(F.countDistinct("sample_id").alias("n")), "layer").filter("cells > 0")
    return _matrix_findings(s.withColumns({"rows": F.col("n") - F.col("no_row"), "cols": F.col("n") - F.col("no_col")}))


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def cell_facts(cells: DataFrame) -> DataFrame:
    """layer, rows, cols, cells (each once), times (the most that one is there), bad (not finite), uneven (with no close cell across the diagonal)."""
    once = cells.groupBy("layer", "i", "j").agg(F.count(F.lit(1)).alias("times"), F.max("similarity").alias("similarity"), F.count(F.when(~_finite("similarity"), 1)).alias("bad"))
    other = once.select("layer", F.col("j").alias("i"), F.col("i").alias("j"), F.col("similarity").alias("other"))
    close = (F.col("similarity") == F.col("other")) & ~F.isnan("similarity") | (F.abs(F.col("similarity") - F.col("other")) <= 1e-5 + 1e-5 * F.abs("other")) & (F.abs("other") != float("inf"))
    return once.join(other, ["layer", "i", "j"], "left").groupBy("layer").agg(
        F.countDistinct("i").alias("rows"), F.countDistinct("j").alias("cols"), F.count(F.lit(1)).alias("cells"), F.max("times").alias("times"),
        F.sum("bad").alias("bad"), F.count(F.when(~F.coalesce(close, F.lit(False)) | F.isnan("other"), 1)).alias("uneven"),
    )


STORED = "layer string, ids array<long>, jds array<long>, below binary, above binary, absent array<int>"


def matrix_blocks(features: DataFrame, block: int = 256) -> DataFrame:
    """Both halves of the features' similarity matrices, ready to be stored: a row for each pair of blocks.

    below: the cells (ids, jds), in a block with itself from the diagonal on, as doubles with equal bytes side by side; above: the cells across the
    diagonal as their difference in bits, compressed, so that equal halves take the room of one; absent: places of cells that are not there.
    """

    def kernel(ids: np.ndarray, jds: np.ndarray, s: np.ndarray) -> tuple:
        x, above = _halves(ids, jds, s)
        return [ids], [jds], [x.view(np.uint8).reshape(-1, 8).T.tobytes()], [above], [_absent(x)]

    return on_block_pairs(features, kernel, STORED, block=block)


@lru_cache(8)
def _no_bits(n: int) -> bytes:
    return zlib.compress(bytes(8 * n), 1)


def _halves(ids: np.ndarray, jds: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The cells of a row of matrix_blocks and its `above`; s: similarities, in a block with itself above the diagonal."""
    other = s
    if len(ids) == len(jds) and (ids == jds).all():
        at = np.triu_indices(len(ids))
        np.fill_diagonal(s, 1.0)
        s, other = s[at], np.maximum(s, s.T).T[at]
    x, y = np.ascontiguousarray(s).reshape(-1), np.ascontiguousarray(other).reshape(-1)
    bits = x.view(np.uint64) ^ y.view(np.uint64)
    return x, zlib.compress(bits.tobytes(), 1) if bits.any() else _no_bits(len(bits))


def _absent(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(x == -np.inf).astype(np.int32)


#: of a stored block: its samples by digest, the ids of one with itself, cells of both halves, those that aren't finite, those with no close cell across the diagonal
JUDGED = "layer string, a string, b string, ids array<long>, cells long, bad long, uneven long"


def _judged(ids: np.ndarray, jds: np.ndarray, x: np.ndarray, above: bytes, absent: np.ndarray) -> tuple:
    """A row of JUDGED after its layer; x: the cells."""
    ids, jds = np.asarray(ids, np.int64), np.asarray(jds, np.int64)
    same = len(ids) == len(jds) and bool((ids == jds).all())
    y = (x.view(np.uint64) ^ np.frombuffer(zlib.decompress(above), np.uint64)).view(np.float64)
    there = np.ones(len(x), bool)
    there[np.asarray(absent, np.int64)] = False
    twice = there.copy()  # cells with another one across the diagonal
    if same:
        i, j = np.triu_indices(len(ids))
        twice &= i != j
    even = bool((x == y).all())
    with np.errstate(invalid="ignore"):
        close = lambda a, b: (a == b) | (np.abs(a - b) <= 1e-5 + 1e-5 * np.abs(b)) & ~np.isinf(b)
        uneven = 0 if even else (~close(x, y) & there).sum() + (~close(y, x) & twice).sum()
    keys = [hashlib.md5(k.tobytes()).hexdigest() for k in (ids, jds)]
    whole = len(x) == (len(ids) * (len(ids) + 1) // 2 if same else len(ids) * len(jds))
    odd = ~np.isfinite(x)
    bad = (odd & there).sum() + ((odd if even else ~np.isfinite(y)) & twice).sum()
    return *sorted(keys), ids.tolist() if same else [], int(there.sum() + twice.sum()) if whole else -1, int(bad), int(uneven)


def block_facts(blocks: DataFrame) -> DataFrame:
    """cell_facts of stored matrix_blocks: every cell of both halves is read and judged in its block's task."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = lambda below: np.ascontiguousarray(np.frombuffer(below, np.uint8).reshape(8, -1).T).view(np.float64).reshape(-1)
            out = [(layer, *_judged(ids, jds, cells(below), above, absent)) for layer, ids, jds, below, above, absent in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in JUDGED.split(", ")])

    return _facts(blocks.select(*[x.split()[0] for x in STORED.split(", ")]).mapInPandas(judge, JUDGED))


def stored_facts(features: DataFrame, block: int = 512) -> DataFrame:
    """block_facts of the features' matrix_blocks: a task stores each block (its cells as they are) in a file of its own, reads it back, judges every cell of both halves and drops the file, so a worker has one block on disk at a time."""

    def kernel(ids: np.ndarray, jds: np.ndarray, s: np.ndarray) -> tuple:
        x, above = _halves(ids, jds, s)
        with tempfile.TemporaryDirectory(prefix="simgrove-") as d:
            at = os.path.join(d, "block.parquet")
            row = pa.table({"ids": [ids], "jds": [jds], "below": [x.tobytes()], "above": [above], "absent": [_absent(x)]})
            pq.write_table(row, at, compression="none", use_dictionary=False, write_statistics=False)
            t = pq.read_table(at)
        ids, jds, absent = (t[k].combine_chunks().values.to_numpy() for k in ("ids", "jds", "absent"))
        below, above = (t[k][0].as_buffer() for k in ("below", "above"))
        return tuple([x] for x in _judged(ids, jds, np.frombuffer(below, np.float64), above, absent))

    return _facts(on_block_pairs(features, kernel, JUDGED, block=block))


def _facts(judged: DataFrame) -> DataFrame:
    """As cell_facts, from the facts of blocks."""
    b = judged.persist()  # a row for each block
    each = b.groupBy("layer", "a", "b").agg(F.count(F.lit(1)).alias("times"), F.max("cells").alias("cells"), F.sum("bad").alias("bad"), F.sum("uneven").alias("uneven"))
    each = each.groupBy("layer").agg(F.sum("cells").alias("cells"), F.max("times").alias("times"), F.sum("bad").alias("bad"), F.sum("uneven").alias("uneven"))
    ids = b.filter("a = b").dropDuplicates(["layer", "a"]).select("layer", F.explode("ids").alias("i")).groupBy("layer", "i").agg(F.count(F.lit(1)).alias("k"))
    ids = ids.groupBy("layer").agg(F.count(F.lit(1)).alias("rows"), F.max("k").alias("k"))
    j = each.join(ids, "layer", "left")
    return j.select("layer", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("rows", F.lit(0)).alias("cols"), "cells", F.greatest("times", "k").alias("times"), "bad", "uneven")


def validate_results(summary: DataFrame, metrics: DataFrame, cells: DataFrame, layers: list[str], n: int, config_sha256: str, manifest_sha256: str) -> DataFrame:
    """Every finding on stored results: layer (null for the whole), rule. Layers are compared both ways; matrices must be whole (n by n, each cell once), finite and symmetric.

    summary: config_sha256, sample_manifest_sha256, n_samples; metrics: layer, convergence_threshold, critical_threshold, critical_rate; cells: layer, i, j, similarity, or the facts that cell_facts, block_facts or stored_facts gives of them.
    """
    spark = summary.sparkSession
    finite = _finite
    whole = lambda cond, rule: s.agg(F.count(F.when(cond, 1)).alias("ok"), F.count(F.lit(1)).alias("k")).filter((F.col("ok") != 1) | (F.col("k") != 1)).select(F.lit(None).cast("string").alias("layer"), F.lit(rule).alias("rule"))
    by_layer = lambda df, rule: df.select("layer", F.lit(rule).alias("rule"))
    s, m = summary, metrics.withColumn("layer", F.col("layer").cast("string"))
    expected = spark.createDataFrame([(x,) for x in layers], "layer string")
    c = cell_facts(cells) if "i" in cells.columns else cells
    parts = [
        whole(F.col("config_sha256") == config_sha256, "config hash"), whole(F.col("sample_manifest_sha256") == manifest_sha256, "manifest hash"), whole(F.col("n_samples") == n, "sample count"),
        by_layer(expected.join(m, "layer", "left_anti"), "missing layer"), by_layer(m.join(expected, "layer", "left_anti"), "unexpected layer"), by_layer(duplicate_keys(m, "layer"), "repeated layer"),
        *[by_layer(m.filter(~finite(k)), f"invalid {k}") for k in ("convergence_threshold", "critical_threshold", "critical_rate")],
        by_layer(expected.unionByName(m.select("layer")).distinct().join(c, "layer", "left_anti"), "missing matrix"),
        by_layer(c.filter((F.col("rows") != n) | (F.col("cols") != n) | (F.col("cells") != n * n) | (F.col("times") != 1)), "shape"),
        by_layer(c.filter("bad > 0"), "not finite"), by_layer(c.filter("uneven > 0"), "not symmetric"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_sample(manifest: DataFrame, files: DataFrame, strata: DataFrame, target: int, allowed: list[str], least_width: int, least_height: int) -> DataFrame:
    """Every finding on a manifest: rule, subject. files: filename, sha256, width, height; strata: family."""
    m = manifest.join(files.select("filename", F.col("sha256").alias("f_sha"), F.col("width").alias("f_w"), F.col("height").alias("f_h")), "filename", "left")
    rule = lambda df, cond, name, subject: df.filter(cond).select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"))
    name = F.col("filename")
    there = F.col("f_sha").isNotNull()
    parts = [
        manifest.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != target).select(F.lit("count").alias("rule"), F.col("n").cast("string").alias("subject")),
        duplicate_keys(manifest, "occurrence_key").select(F.lit("duplicate_key").alias("rule"), F.col("occurrence_key").cast("string").alias("subject")),
        manifest.select("family").distinct().join(strata, "family", "left_anti").select(F.lit("unexpected_family").alias("rule"), F.col("family").alias("subject")),
        rule(m, ~F.coalesce(F.col("media_license_normalized").isin(allowed), F.lit(False)), "license", name),
        rule(m, filled(F.col("media_license")).isNull(), "no_license_text", name), rule(m, filled(F.col("publisher_media_identifier")).isNull(), "no_identifier", name),
        rule(m, filled(F.col("media_attribution")).isNull(), "no_attribution", name), rule(m, ~there, "missing_file", name),
        rule(m, there & (F.col("f_sha") != F.col("sha256")), "hash", name), rule(m, there & ((F.col("f_w") != F.col("width")) | (F.col("f_h") != F.col("height"))), "dimensions", name),
        rule(m, there & ((F.col("f_w") < least_width) | (F.col("f_h") < least_height)), "below_minimum", name),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify_manifest(manifest: DataFrame, files: DataFrame, name: str = "filename", sha: str = "sha256") -> DataFrame:
    """name, status (ok, missing, invalid) of each manifest row."""
    f = files.select(F.col(name), F.col(sha).alias("found"))
    s = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col(sha), "invalid").otherwise("ok")
    return manifest.join(f, name, "left").select(name, s.alias("status"))


def set_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: what only one side has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def failure_counts(attempts: DataFrame, group: str, reason: str) -> DataFrame:
    """group, reasons: a map from reason to count."""
    c = attempts.groupBy(group, reason).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("reasons"))
