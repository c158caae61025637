"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to DIMS dimensions by CURVES random rotations, each with its own shift, and ordered along a Hilbert curve. Each
ordering is cut into key ranges of about BLOCK rows (at most BLOCKS of them). A query meets the ranges within `reach` of
its own on every curve: its key windows. Queries of neighbouring ranges form a span of about SPAN queries, and a task streams the
ranges of a span's windows past its queries, keeping each query's best, so that what comes out grows with the queries, not with the windows. The
curves' candidates are merged and reranked by inner products in double precision.

The projection's scale, the range borders and the reach come from bounded samples (FIT_ROWS rows; TUNE_QUERIES queries searched
exactly over all rows), the reach being the least that holds TARGET of the sampled true neighbours on one curve or another. Every row is indexed. Where data have
no low-dimensional order the windows of all curves come to more than one pass over everything; then one order is searched whole, which is exact.

Equal vectors are indexed once, with their smallest KEEP ids: no further id of such a group can be among a query's nearest.

Defined results: vectors that are null, empty, zero, with null or non-finite components or with a null id take no part; vectors are compared with those of
their own length only, and lengths other than the commonest are searched whole; repeated rows of an id count once; fewer candidates than asked for are all
returned; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simgrove.llm.common import stored

CURVES, DIMS, BITS, BLOCK, BLOCKS = 4, 8, 8, 64, 4096
FIT_ROWS, TUNE_QUERIES, TARGET = 20_000, 48, 0.97
#: queries of a span; queries and rows that a task compares at once; rows below which a window is not shared out between tasks
SPAN, ASKED, CHUNK, SHARE = 4096, 512, 1024, 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each integer cell (rows of coordinates below 2**bits) on the Hilbert curve: Gray-code transposition, then interleaved bits."""
    x = cells.astype(np.uint32).T.copy()
    n, one = len(x), np.uint32(1)
    q = 1 << (bits - 1)
    while q > 1:
        p, qq = np.uint32(q - 1), np.uint32(q)
        for i in range(n):
            hit = (x[i] & qq) != 0
            t = np.where(hit, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t if i else np.uint32(0)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint32(q)) != 0, t ^ np.uint32(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint32(b)) & one).astype(np.uint64)
    return key


class Curves:
    """Rotations, scales and shifts fitted on a sample, and each curve's range borders."""

    def __init__(self, sample: np.ndarray, n_rows: int, seed: int = 31):
        rng, d = np.random.default_rng(seed), sample.shape[1]
        dims = min(DIMS, d)
        self.rotations = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, :dims] for _ in range(CURVES)]
        self.scales, self.borders = [], []
        blocks = max(1, min(BLOCKS, -(-n_rows // BLOCK)))
        for i, r in enumerate(self.rotations):
            p = sample @ r
            mid, width = p.mean(axis=0), np.maximum(p.std(axis=0), 1e-12)
            self.scales.append((mid, width, rng.uniform(-0.5, 0.5, dims) if i else np.zeros(dims)))
            k = np.sort(self.keys(sample, i))
            self.borders.append(k[[len(k) * j // blocks for j in range(1, blocks)]] if blocks > 1 else np.zeros(0, np.uint64))
        self.blocks = blocks

    def keys(self, v: np.ndarray, i: int) -> np.ndarray:
        mid, width, shift = self.scales[i]
        u = ((v @ self.rotations[i] - mid) / width + shift) / 7 + 0.5
        return hilbert_keys(np.clip(u * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32), BITS)

    def block_of(self, v: np.ndarray, i: int) -> np.ndarray:
        return np.searchsorted(self.borders[i], self.keys(v, i), side="right")


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added component by component, so that equal vectors score equally wherever they are compared."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Nearest:
    """The k best rows of each query so far; rows come in batches."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.at, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(q), -np.inf)

    def add(self, v: np.ndarray, ids: np.ndarray) -> None:
        for lo in range(0, len(v), CHUNK):
            w, names = v[lo : lo + CHUNK], ids[lo : lo + CHUNK]
            found = [(self.at, self.ids, self.score)]
            for q0 in range(0, len(self.q), ASKED):
                s = self.q[q0 : q0 + ASKED] @ w.T
                level = self.least[q0 : q0 + ASKED]
                if len(w) > self.k:
                    level = np.maximum(level, np.partition(s, len(w) - self.k, axis=1)[:, len(w) - self.k])
                # the product's own rounding must not lose a tie
                i, j = np.nonzero(s >= (level - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(level), level, 0.0))))[:, None])
                found.append((q0 + i, names[j], exact_scores(self.q[q0 + i], w[j])))
            at, got, score = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((got, -score, at))
            at, got, score = at[order], got[order], score[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            keep = rank < self.k
            self.at, self.ids, self.score = at[keep], got[keep], score[keep]
            full = rank == self.k - 1
            self.least[at[full]] = score[full]


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def search(rows: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries (ids divisible by `every`)."""
    spark, keep = rows.sparkSession, k + 1
    v = stored(valid_vectors(rows, vec_id, embedding), "vectors")
    # equal vectors: the smallest ids, first within salted parts of a group
    part = v.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids"))
    groups = part.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids")).withColumn("gid", F.col("ids")[0])
    groups = stored(groups, "groups")
    n = groups.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    asked = v.filter(F.col("vec_id") % every == 0).select("vec_id", "v").distinct().join(groups.select(F.col("v").alias("gv"), "gid"), F.col("v") == F.col("gv"))
    asked = stored(asked.select("vec_id", "gid"), "asked")
    queries = stored(groups.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "v"), "queries")

    cells, _ = dealt(groups, queries, keep)
    units = cells.repartition("curve", "span", "part").sortWithinPartitions("curve", "span", "part", F.desc("query"))
    found = units.mapInArrow(lambda batches: _searched(batches, keep), "q long, gid long, score double").distinct()
    best = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "gid"))).filter(F.col("n") <= keep)
    # a group's ids are spread before the query's own is left out
    wide = best.join(groups.select("gid", "ids"), "gid").select("q", "score", F.explode("ids").alias("vec_id"))
    wide = wide.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= keep)
    lists = wide.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    out = asked.withColumnRenamed("vec_id", "query_id").join(lists, F.col("gid") == F.col("q"))
    out = out.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def dealt(groups: DataFrame, queries: DataFrame, keep: int) -> tuple[DataFrame, dict]:
    """Rows and queries (gid, v, query) by unit of work (curve, span, part), and what was chosen: blocks, reach, curves, rows compared for a query."""
    spark, h = groups.sparkSession, F.xxhash64("gid")
    lengths = groups.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    length, n = lengths.orderBy(F.desc("n"), "d").first()
    of = lambda df, main: df.select("gid", "v").filter(F.size("v") == length if main else F.size("v") != length)
    rows, asks = of(groups, True), of(queries, True)
    curves = Curves(np.stack(rows.orderBy(h, "gid").limit(FIT_ROWS).toPandas()["v"].to_numpy()), n)
    some = asks.orderBy(F.xxhash64("gid", F.lit(5)), "gid").limit(TUNE_QUERIES).toPandas()
    reach = tuned_reach(rows, curves, some, keep - 1) if curves.blocks > 1 and len(some) else 0
    whole = CURVES * (2 * reach + 1) >= curves.blocks  # the windows come to a whole pass: one order, searched whole
    used, reach = (1, curves.blocks) if whole else (CURVES, reach)

    def homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b)
                for c in range(used):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(curves.block_of(v, c).astype(np.int32))], names=["curve", "block"])

    asked = np.zeros((used, curves.blocks), np.int64)
    for r in asks.mapInArrow(homes, "curve int, block int").groupBy("curve", "block").count().collect():  # at most CURVES * BLOCKS rows
        asked[r["curve"], r["block"]] = r["count"]
    # spans of neighbouring ranges with about SPAN queries; each curve's first and last range of its spans
    span_of = [((np.cumsum(a) - 1).clip(0) // SPAN).astype(np.int64) for a in asked]
    span_of = [np.unique(s, return_inverse=True)[1] for s in span_of]
    firsts = [np.searchsorted(s, np.arange(s[-1] + 1)) for s in span_of]
    lasts = [np.searchsorted(s, np.arange(s[-1] + 1), side="right") - 1 for s in span_of]
    spans = max(len(f) for f in firsts)
    window = n * min(1.0, (curves.blocks / spans + 2 * reach) / curves.blocks)
    parts = max(1, min(-(-int(window) // SHARE), -(-2 * spark.sparkContext.defaultParallelism // (spans * used))))

    def deal(query: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v, names = _matrix(b), b.column("gid").to_numpy()
                for c in range(used):
                    block = curves.block_of(v, c)
                    if query:
                        lo = hi = span_of[c][block]
                    else:  # the spans whose windows hold the range
                        lo, hi = np.searchsorted(lasts[c], block - reach), np.searchsorted(firsts[c], block + reach, side="right") - 1
                    own = (names % parts + parts) % parts
                    for step in range(int((hi - lo).max()) + 1):
                        at = np.flatnonzero(lo + step <= hi)
                        t = b.take(pa.array(at))
                        for part in range(parts) if query else (None,):
                            p = np.full(len(at), part) if query else own[at]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array((lo[at] + step).astype(np.int32)), pa.array(p.astype(np.int32)), t.column("gid"), t.column("v"), pa.array([query] * len(at))], names=["curve", "span", "part", "gid", "v", "query"])

        return run

    schema = "curve int, span int, part int, gid long, v array<double>, query boolean"
    cells = rows.mapInArrow(deal(False), schema).unionByName(asks.mapInArrow(deal(True), schema))
    if lengths.count() > 1:  # the other lengths: each searched whole, by slices of its queries
        few, few_asks = of(groups, False), of(queries, False)
        slices = max(1, -(-few_asks.count() // SPAN))
        base = [(F.lit(CURVES) + F.size("v")).cast("int").alias("curve")]
        cells = cells.unionByName(few.select(*base, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("span"), F.lit(0).alias("part"), "gid", "v", F.lit(False).alias("query")))
        cells = cells.unionByName(few_asks.select(*base, F.pmod(h, F.lit(slices)).cast("int").alias("span"), F.lit(0).alias("part"), "gid", "v", F.lit(True).alias("query")))
    return cells, {"blocks": curves.blocks, "reach": reach, "curves": used, "compared": n if whole else used * window}


def _searched(batches: Iterable[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """A sorted partition: each unit's queries come first, then its rows stream past them."""
    unit, names, near, asked = None, np.zeros(0, np.int64), None, []

    def best() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names[near.at]), pa.array(near.ids), pa.array(near.score)], names=["q", "gid", "score"])

    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in ("curve", "span", "part")], axis=1)
        query = b.column("query").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (query[1:] != query[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if lo == hi:
                continue
            piece, key = b.slice(lo, hi - lo), tuple(keys[lo])
            if key != unit:
                if near is not None:
                    yield best()
                unit, near, asked = key, None, []
            v, ids = _matrix(piece), piece.column("gid").to_numpy()
            if query[lo]:
                asked.append((ids, v))
            elif asked or near is not None:
                if near is None:
                    names, near, asked = np.concatenate([x for x, _ in asked]), Nearest(np.concatenate([x for _, x in asked]), keep), []
                near.add(v, ids)
    if near is not None:
        yield best()


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)


def tuned_reach(groups: DataFrame, curves: Curves, some: pd.DataFrame, k: int) -> int:
    """The least reach that holds TARGET of the true neighbours of some queries, which are searched over all rows."""
    q = np.stack(some["v"].to_numpy())
    homes = np.stack([curves.block_of(q, c) for c in range(CURVES)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, ids = _matrix(b), b.column("gid").to_numpy()
            place = {int(g): i for i, g in enumerate(ids)}
            far = np.min(np.stack([np.abs(curves.block_of(v, c)[None, :] - homes[c][:, None]) for c in range(CURVES)]), axis=0)
            near = Nearest(q, k + 1)
            near.add(v, ids)
            at = np.array([place[int(x)] for x in near.ids], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.at), pa.array(near.ids), pa.array(near.score), pa.array(far[near.at, at].astype(np.int64))], names=["q", "gid", "score", "far"])

    near = groups.select("gid", "v").mapInArrow(run, "q long, gid long, score double, far long")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "gid"))).filter(F.col("n") <= k + 1)
    far = sorted(r[0] for r in near.select("far").collect())  # at most TUNE_QUERIES * (k + 1)
    return int(far[min(len(far) - 1, int(np.ceil(len(far) * TARGET)))])


ORACLE = """
with v as (select vec_id, embedding::double[] e from embeddings where embedding is not null),
s as (select q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.e, c.e) score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
