"""Near-duplicate detection: banded MinHash with odd sketches.

Texts become sets of five-word shingles. SAMPLES MinHash values fill BANDS bands and are folded into a parity bitmap (odd sketch). The
population count of two bitmaps' XOR estimates how many samples differ, and so a high similarity, before any set is read.
Links are confirmed on the full sets, each shingle a 64-bit number.

Rows with equal sets (SHA-256 over the sorted set) are one class from the start. In each band bucket every class is compared with one pivot, for ROUNDS
rounds. In buckets that still hold several components, classes outside the largest component meet all others, in pairs of blocks of bounded size: bitmaps
tell which classes can have a link there at all, and only their sets travel. A task compares whole sets, skips what is joined already
and returns a forest: fewer links than it has classes, however many pairs are similar. No bucket is cut short.
At similarity 0.75 a pair misses all bands with probability 5e-6, and the bitmap test (0.5) with about 1e-5.

Defined results: a null, empty or blank text has an empty set, is linked with nothing and kept; fewer than five words make one shingle; rows with
the same id are one document (their links are joined); a row without id is linked like any other, its component_id is the smallest id reached (null
if there is none, and then kept is true); a very long text is one row of a task, its set 8 bytes a shingle; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import broadcast_if_small, chunks, discard, fresh, mix64, stored, utf8, word_hashes, words_of
from simgrove.llm.components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, BITS = 32, 4, 512
SAMPLES = BANDS * ROWS
LOW = 0.5
ROUNDS = 2
#: classes, and shingles, of a block: a task holds two blocks
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: ids and keys of 16 bytes: up to so many are broadcast
BROADCAST_IDS = 1_000_000

_R = np.random.default_rng(977)
_WORD = _R.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _R.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_MUL = _R.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _R.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingle hashes of each document, concatenated, and where each document's begin and end."""
    start, end, doc = words_of(data, offsets)
    h = word_hashes(data, start, end)
    n_docs = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    count = np.diff(first)
    with np.errstate(over="ignore"):
        m = max(0, len(h) - SHINGLE + 1)
        whole = sum((h[j : j + m] * _WORD[j] for j in range(SHINGLE)), np.zeros(m, np.uint64))
        whole = mix64(whole)
        out, bounds = [], [0]
        for i in range(n_docs):
            a, c = first[i], count[i]
            if c >= SHINGLE:
                u = np.unique(whole[a : a + c - SHINGLE + 1])
            elif c:
                u = mix64(np.array([(h[a : a + c] * _WORD[:c]).sum() + np.uint64(c)], np.uint64))
            else:
                u = np.zeros(0, np.uint64)
            out.append(u)
            bounds.append(bounds[-1] + len(u))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(bounds)


def min_hashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SAMPLES minima for each document; rows of documents without shingles hold no meaning."""
    n = len(bounds) - 1
    out = np.zeros((n, SAMPLES), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(full):  # as many documents as stay in the processor's cache
            hi = max(lo + 1, int(np.searchsorted(bounds[full + 1], bounds[full[lo]] + 32768, side="right")))
            sel = full[lo:hi]
            part = hashes[bounds[sel[0]] : bounds[sel[-1] + 1]]
            at = bounds[sel] - bounds[sel[0]]
            for j in range(SAMPLES):
                out[sel, j] = np.minimum.reduceat((part ^ _XOR[j]) * _MUL[j], at)
            lo = hi
    return out


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the (sample number, value) pairs, BITS bits as 64-bit words."""
    with np.errstate(over="ignore"):
        bit = (mix64(mins + _XOR[::-1] * np.uint64(3)) % np.uint64(BITS)).astype(np.int64)
    flat = bit + np.arange(len(mins))[:, None] * BITS
    parity = np.bincount(flat.ravel(), minlength=len(mins) * BITS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(-1, BITS), axis=1, bitorder="little").view(np.uint64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (mix64(mins.reshape(len(mins), BANDS, ROWS)) * _ROW).sum(axis=2, dtype=np.uint64)
        return mix64(v + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.astype(np.uint64).view(np.int64).ravel()))


def _digests(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The first 16 bytes of SHA-256 over each sorted set."""
    raw, at = np.ascontiguousarray(hashes).tobytes(), (bounds * 8).tolist()
    return [hashlib.sha256(raw[i:j]).digest()[:16] for i, j in zip(at, at[1:])]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n (set size), digest (of the set), bands, odd."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 2 << 20, 1 << 13):
            hashes, bounds = shingle_hashes(*utf8(b.column("text")))
            mins = min_hashes(hashes, bounds)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(_digests(hashes, bounds), pa.binary()), _lists(band_keys(mins)), _lists(odd_sketches(mins))],
                names=["doc_id", "text_key", "n", "digest", "bands", "odd"],
            )

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, text_key long, n long, digest binary, bands array<long>, odd array<long>")


def shingle_sets(docs: DataFrame, picks: DataFrame, n_picks: int, doc_id: str, text: str) -> DataFrame:
    """digest, shingles (a sorted set of 64-bit numbers) of the rows in picks (doc_id, text_key)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 2 << 20, 1 << 13):
            hashes, bounds = shingle_hashes(*utf8(b.column("text")))
            raw, at = np.ascontiguousarray(hashes).tobytes(), (bounds * 8).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(_digests(hashes, bounds), pa.binary()), pa.array([raw[i:j] for i, j in zip(at, at[1:])], pa.binary())], names=["digest", "shingles"])

    p = picks.select(F.col("doc_id").alias("pick_id"), F.col("text_key").alias("pick_key"))
    same = F.col("doc_id").eqNullSafe(F.col("pick_id")) & (F.col("text_key") == F.col("pick_key"))
    got = _rows(docs, doc_id, text).join(broadcast_if_small(p, n_picks, BROADCAST_IDS), same, "left_semi")
    return got.select("text").mapInArrow(run, "digest binary, shingles binary").dropDuplicates(["digest"])


def likely(odd_a: Column, odd_b: Column, n_a: Column, n_b: Column) -> Column:
    """Whether bitmaps and set sizes leave the similarity possible."""
    z = F.aggregate(F.zip_with(odd_a, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return (z <= F.lit(far_bits())) & (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT)


def far_bits(low: float = LOW) -> int:
    """The XOR count that a similarity of `low` gives on average: of 2 * SAMPLES * (1 - low) differing entries, an odd number in a bit."""
    differ = 2 * SAMPLES * (1 - low)
    return int(np.ceil(BITS * (1 - np.exp(-2 * differ / BITS)) / 2))


def similar(common: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return (common > 0) & (100 * common >= PERCENT * (n_a + n_b - common))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b, da, db), the (a, b) whose full sets, named by their digests, are similar."""
    of = lambda side: sets.select(F.col("digest").alias(f"d{side}"), F.col("shingles").alias(f"s{side}"))
    joined = pairs.join(of("a"), "da").join(of("b"), "db").select("a", "b", "sa", "sb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sa, sb, ok = b.column("sa"), b.column("sb"), np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
                ok[i] = similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a long, b long")


CELL = ["bucket", "wide", "i", "j"]


def _open(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, the classes with a partner in another component that sizes and bitmaps leave possible and that meets them here first."""
    limit = far_bits()
    for batch in batches:
        for r in range(batch.num_rows):
            m = batch.column("m")[r].values
            component, n, left = (m.field(c).to_numpy(zero_copy_only=False) for c in ("component", "n", "left"))
            odd = m.field("odd").flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
            bands = m.field("bands").flatten().to_numpy().reshape(len(n), -1)
            here, inner = batch.column("bucket")[r].as_py(), not batch.column("wide")[r].as_py() and batch.column("i")[r].as_py() == batch.column("j")[r].as_py()
            right = np.flatnonzero(~left) if not inner else np.arange(len(n))
            stays = np.zeros(len(n), bool)
            for k in np.flatnonzero(left):
                at = right[(component[right] != component[k]) & (np.minimum(n[right], n[k]) * 100 >= np.maximum(n[right], n[k]) * PERCENT)]
                at = at[np.bitwise_count(odd[at] ^ odd[k]).sum(axis=1, dtype=np.int64) <= limit] if len(at) else at
                at = at[bands[k][np.argmax(bands[at] == bands[k], axis=1)] == here] if len(at) else at
                if len(at):
                    stays[at] = True
                    stays[k] = True
            at = np.flatnonzero(stays)
            if len(at):
                same = {c: pa.array([batch.column(c)[r].as_py()] * len(at), batch.column(c).type) for c in CELL}
                kept = m.take(pa.array(at))
                yield pa.RecordBatch.from_pydict(same | {c: kept.field(c) for c in ("left", "node", "component", "digest")})


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links within each pair of blocks, as a forest: classes of one component, or joined by earlier links of the task, are not compared."""
    for batch in batches:
        a_out, b_out = [], []
        for r in range(batch.num_rows):
            m = batch.column("m")[r].values
            node, component, left = (m.field(c).to_numpy(zero_copy_only=False).copy() for c in ("node", "component", "left"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in m.field("shingles")]
            n = np.array([len(x) for x in sets], np.int64)
            names, flat = np.unique(np.concatenate(sets), return_inverse=True)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            inner = not batch.column("wide")[r].as_py() and batch.column("i")[r].as_py() == batch.column("j")[r].as_py()
            right = ~left if not inner else np.ones(len(n), bool)
            mark = np.zeros(len(names), bool)
            for k in np.flatnonzero(left):
                if not (right & (component != component[k])).any():
                    continue
                own = flat[first[k] : first[k] + n[k]]
                mark[own] = True
                common = np.add.reduceat(mark[flat].astype(np.int32), first)
                mark[own] = False
                for x in np.flatnonzero(similar(common, n[k], n) & right):
                    if component[x] != component[k]:
                        a_out.append(min(node[k], node[x]))
                        b_out.append(max(node[k], node[x]))
                        component[component == component[x]] = component[k]
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after links (a, b) between nodes."""
    by_a = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
    between = by_a.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return stored(labels.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")


def _cells(c: DataFrame) -> DataFrame:
    """Members (bucket, node, digest, n, component, ...) of buckets with several components, once for each pair of blocks: CELL and left.

    The largest component's classes meet the others only, so a large group with a few strangers costs its size, not its square.
    """
    parts = c.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    size = parts.groupBy("bucket").agg(F.max(F.struct("k", "component", "s")).alias("top"), F.sum("k").alias("k"), F.sum("s").alias("s")).filter("k > top.k")
    blocks = lambda k, s: F.greatest(F.ceil(k / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    size = size.select("bucket", F.col("top.component").alias("major"), blocks(F.col("k") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("few"), blocks(F.col("top.k"), F.col("top.s")).alias("many"))
    m = c.join(size, "bucket").withColumn("minor", F.col("component") != F.col("major"))
    m = m.withColumn("own", F.pmod(F.xxhash64("digest"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many"))).cast("int"))
    cell = lambda wide, i, j, left: F.struct(F.lit(wide).alias("wide"), i.alias("i"), j.alias("j"), left.alias("left"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.col("own")
    minor = F.concat(F.transform(to(F.col("few")), lambda o: cell(False, F.least(o, own), F.greatest(o, own), own <= o)), F.transform(to(F.col("many")), lambda o: cell(True, own, o, F.lit(True))))
    major = F.transform(to(F.col("few")), lambda o: cell(True, o, own, F.lit(False)))
    return m.withColumn("cell", F.explode(F.when(F.col("minor"), minor).otherwise(major))).select("*", "cell.*").drop("cell", "major", "few", "many", "minor", "own")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text), component (a number for each component, null ids too; null for empty sets)."""
    s = stored(sketch(docs, doc_id, text), "sketches")
    known = s.filter("n > 0")
    any_of = [F.any_value(c).alias(c) for c in ("n", "bands", "odd")]
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_key")).alias("pick"), *any_of)
    # a class of rows without ids takes a number from its set
    classes = stored(classes.withColumn("node", F.coalesce("rep", F.lit(1 << 62) + F.pmod(F.xxhash64("digest"), F.lit(1 << 62)))), "classes")
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket")
    light = rows.join(shared, "bucket").join(classes.select("node", "digest", "n", "odd"), "node")
    members = stored(light.select("bucket", "node", "digest", "n", "odd"), "members")
    held = stored(members.select("digest").distinct(), "held")
    picks = stored(classes.join(held, "digest", "left_semi").select("pick.*"), "picks")
    sets = stored(shingle_sets(docs, picks, picks.count(), doc_id, text), "sets")
    scratch = [held, picks]
    several = known.filter("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("d0 <> d1").select("doc_id")
    several = stored(several, "several")
    n_several = several.count()
    labels = stored(members.select("node").distinct().withColumn("component", F.col("node")), "labels")
    if n_several:  # ids with several sets: their classes are one document
        by_id = known.join(broadcast_if_small(several, n_several, BROADCAST_IDS), "doc_id").join(classes.select("digest", "node"), "digest").select("doc_id", "node").distinct()
        by_id = stored(by_id, "by_id")
        labels = stored(labels.select("node").union(by_id.select("node")).distinct().withColumn("component", F.col("node")), "labels")
        labels = _grown(labels, by_id.join(by_id.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")))
    for turn in range(ROUNDS):
        c = members.join(labels, "node")
        apart = c.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("bucket")
        c = stored(c.join(apart, "bucket"), "mixed")
        pivots = c.groupBy("bucket").agg(F.min_by(F.struct("node", "component", "digest", "n", "odd"), F.struct(F.xxhash64("digest", F.lit(turn)), "digest")).alias("p"))
        tried = c.join(pivots, "bucket").filter("component <> p.component").filter(likely(F.col("odd"), F.col("p.odd"), F.col("n"), F.col("p.n")))
        tried = stored(tried.select(F.col("node").alias("a"), F.col("p.node").alias("b"), F.col("digest").alias("da"), F.col("p.digest").alias("db")).distinct(), "tried")
        links = stored(confirm(tried, sets), "links")
        before, labels = labels, _grown(labels, links)
        for x in (c, tried, links, before):
            discard(x)
    c = stored(members.join(labels, "node"), "labelled")
    cells = _cells(c).join(classes.select("digest", "bands"), "digest")
    grouped = cells.groupBy(*CELL).agg(F.collect_list(F.struct("left", "node", "component", "digest", "n", "odd", "bands")).alias("m"))
    opened = stored(grouped.mapInArrow(_open, "bucket long, wide boolean, i int, j int, left boolean, node long, component long, digest binary"), "open")
    grouped = opened.join(sets, "digest").groupBy(*CELL).agg(F.collect_list(F.struct("left", "node", "component", "shingles")).alias("m"))
    links = stored(grouped.select("wide", "i", "j", "m").mapInArrow(_forest, "a long, b long").distinct(), "links")
    labels = _grown(labels, links)
    # a component is named by its smallest real id
    grown = classes.select("digest", "node", "rep").join(labels, "node", "left")
    names = grown.filter("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("name"))
    final = grown.join(names, F.col("component") == F.col("c"), "left")
    final = stored(final.select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("component"), F.when(F.col("c").isNull(), F.col("rep")).otherwise(F.col("name")).alias("name")), "named")
    out = s.join(final, F.col("digest") == F.col("d"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"), "text_key", "component")
    out = stored(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "text_key", "component"), "near_duplicates")
    for x in (s, classes, members, sets, c, opened, links, labels, final, several, *scratch):
        discard(x)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns kept: of each component the row with the smallest id (rows without id last), of equal rows one; and all with empty sets."""
    n = near_duplicates(docs)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = stored(n.filter("component is not null").groupBy("component").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("rows")), "best")
    same = [F.col("doc_id").eqNullSafe(F.col("best.doc_id")), F.col("text_key") == F.col("best.text_key")]
    again = n.join(best.withColumnRenamed("component", "c").filter("rows > 1"), F.col("component") == F.col("c")).withColumn("wins", same[0] & same[1])
    again = stored(again.groupBy(F.col("doc_id").alias("near_id"), F.col("text_key").alias("near_key")).agg(F.max("wins").alias("near_wins"), F.count(F.lit(1)).alias("near_rows")), "shared")
    there, near_id, near_key = (fresh(x, docs) for x in ("text_key", "near_id", "near_key"))
    d = docs.withColumn(there, F.xxhash64("text"))
    again = again.withColumnsRenamed({"near_id": near_id, "near_key": near_key})
    match = F.col("doc_id").eqNullSafe(F.col(near_id)) & (F.col(there) == F.col(near_key))
    pick = [near_id, near_key]
    gone, twice = again.filter("not near_wins").select(*pick), again.filter("near_wins and near_rows > 1").select(*pick)
    stays = d.join(broadcast_if_small(gone, gone.count(), BROADCAST_IDS), match, "left_anti")
    n_twice = twice.count()
    if not n_twice:
        return stays.select(*docs.columns)
    single = stays.join(broadcast_if_small(twice, n_twice, BROADCAST_IDS), match, "left_anti")
    one = stays.join(broadcast_if_small(twice, n_twice, BROADCAST_IDS), match, "left_semi").dropDuplicates(["doc_id", there])
    return single.unionByName(one).select(*docs.columns)


ORACLE = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, array_to_string(case when len(w) >= 5 then w[i:i+4] else w end, ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from d union select e.b, r.root from r join e on e.a = r.doc_id where r.root < e.b),
c as (select doc_id, min(root) component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) n_shingles, c.component_id, d.doc_id = c.component_id kept
from d left join n using (doc_id) join c using (doc_id)
"""
