"""Exact substring deduplication with a distributed difference-cover suffix sort.

Every string of LENGTH bytes that also starts in a document with a smaller id is found, over the bytes of whole texts.

1. Windows go to buckets by content: a window's minimizer is the smallest hash of its GRAM-byte pieces, so equal windows have equal minimizers. A
   count over all documents tells which minimizers occur in two documents or more; windows with other minimizers cannot repeat.
2. The remaining windows travel as runs: neighbouring windows with one minimizer are one string, kept once for each batch with its smallest
   document. Windows with a very common minimizer route by the next smallest hash, so that what surrounds a common line spreads over buckets.
3. Each bucket sorts its suffixes by a difference cover modulo 3: places with residue 1 and 2 are sampled; triples of their 8-byte
   symbols are sorted and named; the recursion sorts triples of names; the remaining suffixes take a byte and the name after it; the three sorted
   lists merge by the residues' common offsets. Suffixes are compared to LENGTH bytes. Neighbours with equal prefixes form groups,
   and each group's smallest document is known.
4. Buckets answer which windows occur in a smaller document; batches mark the bytes and return each document's digest.

A bucket's suffixes need no other bucket, because equal windows meet in one: names and merges stay local while the sort is distributed.

Defined results: a null text is an empty one; texts shorter than LENGTH lose nothing; a null id counts as greater than all others; rows with the same
id are one document and don't remove from one another; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import discard, mix64, n_partitions, powers, stored
from simgrove.llm.packed import Batch, batched, order_of, pack, release, unpack

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
#: text bytes of a batch; text bytes for each bucket (all texts counted); windows, or text bytes, that a task works on at once: its arrays take about 150 times as many bytes
BATCH, BUCKET, PIECE = 2 << 20, 16 << 20, 1 << 18
#: a minimizer in so many documents of a batch-sized share is "very common"
COMMON = 64
NONE = np.iinfo(np.int64).max
_BYTE = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _STEP = np.uint64(0xD6E8FEB86659FD93), 1 << 14
_PINV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_POW, _INV = powers(_STEP + LENGTH, _P), powers(_STEP + LENGTH + 1, _PINV)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 63-bit hash of the GRAM bytes at each place, in pieces that stay in the processor's cache."""
    n = len(data) - GRAM + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, max(0, n), _STEP):
            hi = min(n, lo + _STEP)
            piece = data[lo : hi + GRAM - 1]
            run = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * _POW[: len(piece)], out=run[1:])
            v = (run[GRAM:] - run[:-GRAM]) * _INV[: hi - lo]
            v ^= v >> np.uint64(32)
            v *= np.uint64(0x9E3779B97F4A7C15)
            out[lo:hi] = v >> np.uint64(1)
    return out


def sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each `span` neighbours, by doubling, in pieces that stay in the processor's cache."""
    n = len(h) - span + 1
    out = np.zeros(max(0, n), h.dtype)
    for lo in range(0, max(0, n), _STEP):
        hi = min(n, lo + _STEP)
        part, width = h[lo : hi + span - 1], 1
        while 2 * width <= span:
            part = np.minimum(part[: len(part) - width], part[width:])
            width *= 2
        rest = span - width
        out[lo:hi] = np.minimum(part[: len(part) - rest], part[rest:]) if rest else part
    return out


def second_min(h: np.ndarray, span: int) -> np.ndarray:
    """The second smallest different value of each `span` neighbours; the greatest number where all are equal."""

    def merged(a1, a2, b1, b2):
        low = np.minimum(a1, b1)
        rest = np.minimum(a2, b2)
        return low, np.where(a1 == b1, rest, np.minimum(np.maximum(a1, b1), rest))

    n = len(h) - span + 1
    out = np.zeros(max(0, n), h.dtype)
    for lo in range(0, max(0, n), _STEP):
        hi = min(n, lo + _STEP)
        one, width = h[lo : hi + span - 1], 1
        two = np.full(len(one), np.iinfo(np.uint64).max, np.uint64)
        while 2 * width <= span:
            one, two = merged(one[:-width], two[:-width], one[width:], two[width:])
            width *= 2
        if rest := span - width:
            one, two = merged(one[:-rest], two[:-rest], one[rest:], two[rest:])
        out[lo:hi] = two
    return out


class Windows:
    """A batch's windows: all strings of LENGTH bytes within one document, as runs of neighbours with one minimizer: start, n (windows), doc, m."""

    def __init__(self, b: Batch):
        self.b, parts = b, []
        for lo in range(0, len(b.data) - LENGTH + 1, PIECE):
            hi = min(len(b.data) - LENGTH + 1, lo + PIECE)
            m = sliding_min(gram_hashes(b.data[lo : hi + LENGTH - 1]), SPAN)
            ok = np.ones(hi - lo, bool)
            for e in b.offsets[1:-1][slice(*np.searchsorted(b.offsets[1:-1], (lo + 1, hi + LENGTH)))].tolist():
                ok[max(0, e - LENGTH + 1 - lo) : max(0, e - lo)] = False  # these cross a document's end
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (m[1:] != m[:-1])
            first = np.flatnonzero(new)
            stop = np.flatnonzero(new | ~ok)  # where a run can end
            after = np.searchsorted(stop, first, side="right")
            end = np.append(stop, hi - lo)[after]
            parts.append((first + lo, end - first, m[first]))
        self.start, self.n, self.m = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.doc = np.searchsorted(b.offsets, self.start, side="right") - 1

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers and the number of the batch's documents that have each."""
        if not len(self.m):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        o = np.argsort(self.m, kind="stable")
        m, d = self.m[o], self.doc[o]
        first = np.ones(len(m), bool)
        first[1:] = m[1:] != m[:-1]
        each = first.copy()
        each[1:] |= d[1:] != d[:-1]
        return m[first], np.add.reduceat(each.astype(np.int64), np.flatnonzero(first))

    def runs(self, keys: np.ndarray, flags: np.ndarray) -> "Runs":
        """keys, flags: the minimizers found in several documents (flag 1), or in very many (flag 2)."""
        out = Runs()
        if not len(keys) or not len(self.m):
            return out
        at = np.minimum(np.searchsorted(keys, self.m), len(keys) - 1)
        flag = np.where(keys[at] == self.m, flags[at], 0)
        plain = np.flatnonzero(flag == 1)
        parts = [(self.start[plain], self.n[plain], self.m[plain])]
        often = np.flatnonzero(flag > 1)  # a window's route is a matter of its own bytes and of its own minimizer's flag, which all batches know
        for part in np.split(often, np.flatnonzero(np.diff(self.start[often] // PIECE)) + 1) if len(often) else ():
            lo, hi = int(self.start[part[0]]), int(self.start[part[-1]] + self.n[part[-1]])
            second = second_min(gram_hashes(self.b.data[lo : hi + LENGTH - 1]), SPAN)
            place = np.repeat(self.start[part] - np.concatenate([[0], np.cumsum(self.n[part])[:-1]]), self.n[part]) + np.arange(int(self.n[part].sum()))
            route = second[place - lo]
            route = np.where(route == np.iinfo(np.uint64).max, np.repeat(self.m[part], self.n[part]), route)
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1] + 1) | (route[1:] != route[:-1])
            first = np.flatnonzero(new)
            parts.append((place[first], np.diff(np.append(first, len(place))), route[first]))
        start, n, route = (np.concatenate(x) for x in zip(*parts))
        o = np.argsort(start)
        out.start, out.windows, out.route = start[o], n[o], route[o]
        out.doc = np.searchsorted(self.b.offsets, out.start, side="right") - 1
        return out


class Runs:
    start = windows = doc = np.zeros(0, np.int64)
    route = np.zeros(0, np.uint64)

    def distinct(self, b: Batch, buckets: int) -> None:
        """Orders equal strings together, within buckets: `order`, and `lead` (first of equals: the smallest document)."""
        n = len(self.start)
        texts = [b.data[s : s + w + LENGTH - 1].tobytes() for s, w in zip(self.start.tolist(), self.windows.tolist())]
        names: dict[bytes, int] = {}
        self.name = np.fromiter((names.setdefault(t, len(names)) for t in texts), np.int64, n)
        self.texts = list(names)
        ids = np.array([NONE if i is None else i for i in b.ids], np.int64)[self.doc] if n else np.zeros(0, np.int64)
        self.ids = ids
        self.least = np.full(len(names), NONE, np.int64)
        np.minimum.at(self.least, self.name, ids)
        bucket, self.part = np.zeros(len(names), np.int64), np.zeros(len(names), np.uint8)
        bucket[self.name] = (mix64(self.route) % np.uint64(buckets)).astype(np.int64)
        self.part[self.name] = (mix64(self.route + np.uint64(1)) >> np.uint64(56)).astype(np.uint8)  # parts of a bucket share no window
        self.bucket = bucket
        self.by_bucket = order_of(bucket)


def named(x: np.ndarray) -> np.ndarray:
    """Dense ranks from 0: equal values have equal names, in the values' order."""
    o = np.argsort(x)
    y = x[o]
    new = np.zeros(len(x), np.int64)
    new[1:] = y[1:] != y[:-1]
    out = np.empty(len(x), np.int64)
    out[o] = np.cumsum(new)
    return out


def named_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of small numbers. Where they fit, a pair and its place are one 64-bit number, which sorts faster than an order is found."""
    bits, place = int(y.max()).bit_length(), len(x).bit_length()
    key = (x.astype(np.uint64) << np.uint64(bits)) | y.astype(np.uint64)
    if int(x.max()).bit_length() + bits + place > 64:
        return named(key)
    z = np.sort((key << np.uint64(place)) | np.arange(len(x), dtype=np.uint64))
    value = z >> np.uint64(place)
    new = np.zeros(len(x), np.int64)
    new[1:] = value[1:] != value[:-1]
    out = np.empty(len(x), np.int64)
    out[(z & np.uint64((1 << place) - 1)).astype(np.int64)] = np.cumsum(new)
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A group number for each window start: equal numbers for equal LENGTH-byte strings. data must go on for 8 bytes after the last window.

    Difference-cover suffix sort to LENGTH bytes, cover {1, 2} modulo 3.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    d = data.astype(np.uint64)
    size = len(d)
    two = (d[:-1] << np.uint64(8)) | d[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    sym = (four[:-4] << np.uint64(32)) | four[4:]
    # sampled places at which names are needed: residues 1 and 2 at window starts and up to two places after, and 24 further on
    need = np.zeros(size + 1, bool)
    for k in (0, 1, 2):
        need[starts + k] = True
    at = np.flatnonzero(need)
    at = at[(at % 3 != 0) & (at + 48 <= size)]
    need[:] = False
    need[at] = True
    need[at + 24] = True
    places = np.flatnonzero(need)
    places = places[places + 24 <= size]
    # triples of 8-byte symbols, sorted and named
    a, b, c = sym[places], sym[places + 8], sym[places + 16]
    first = named(a)
    triple = first
    tied = np.flatnonzero(np.bincount(first)[first] > 1)
    if len(tied):
        rest = np.zeros(len(places), np.int64)  # single first symbols need no more
        rest[tied] = named_pairs(named_pairs(first[tied], named(b[tied])), named(c[tied]))
        triple = named_pairs(first, rest)
    name = np.zeros(size + 1, np.uint64)
    name[places] = triple.astype(np.uint64) + np.uint64(1)
    # the recursion: names 24 places apart, for prefixes of 48 bytes
    rank = np.zeros(size + 3, np.uint64)
    rank[at] = named_pairs(name[at].astype(np.int64), name[at + 24].astype(np.int64)).astype(np.uint64) + np.uint64(1)
    # each residue's windows in order, by what the cover gives: rank and the bytes that are left
    r = starts % 3
    lists = {k: starts[r == k] for k in (0, 1, 2)}
    # bytes before the rank are compared as well, so that the three kinds of key order equally

    def key(p: np.ndarray, shift: int) -> np.ndarray:
        """First `shift` bytes, the rank of the 48 bytes after them, then the rest of LENGTH bytes."""
        out = np.zeros(len(p), np.uint64)
        for k in range(shift):
            out = (out << np.uint64(8)) | d[p + k]
        out = (out << np.uint64(32)) | rank[p + shift]
        for k in range(48 + shift, LENGTH):
            out = (out << np.uint64(8)) | d[p + k]
        return out

    own = {0: 1, 1: 0, 2: 0}  # the least shift to a sampled place
    shared = {(0, 1): 1, (0, 2): 2, (1, 2): 0}  # a shift that brings both residues to sampled places
    for k in lists:
        lists[k] = lists[k][np.argsort(key(lists[k], own[k]))]
    place = {k: np.arange(len(lists[k])) for k in lists}
    for (i, j), shift in shared.items():
        x, y = key(lists[i], shift), key(lists[j], shift)
        place[i] = place[i] + np.searchsorted(y, x, side="left")
        place[j] = place[j] + np.searchsorted(x, y, side="right")
    order = np.zeros(n, np.int64)
    for k in lists:
        order[place[k]] = lists[k]
    # neighbours with equal prefixes
    same = np.zeros(max(0, n - 1), bool)
    left = np.arange(max(0, n - 1))
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        left = left[sym[order[left] + k] == sym[order[left + 1] + k]]
    same[left] = True
    number = np.concatenate([[0], np.cumsum(~same)])
    back = np.zeros(size + 1, np.int64)
    back[order] = number
    return back[starts]


_ASK1 = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TELL = pa.schema([("batch", pa.int64()), ("step", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])
TELL = "batch long, step int, bucket int, answer binary"


def _flags(b: Batch, w: Windows, buckets: int, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    keys, _ = w.minimizers()
    flags = np.zeros(len(keys), np.uint8)
    bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
    o = order_of(bucket)
    edge = np.searchsorted(bucket[o], np.arange(buckets + 1))
    for a in answers:
        flags[o[edge[a["bucket"]] : edge[a["bucket"] + 1]]] = unpack(a["answer"], np.uint8)
    return keys, flags


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    store = batched(docs, doc_id, text, BATCH)
    size = store.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda x, n: x + n))).first()[0] or 0
    buckets = max(n_partitions(spark), -(-size // BUCKET))

    def ask_minimizers(batches):
        for rb in batches:
            for row in rb.to_pylist():
                keys, counts = Windows(Batch(row)).minimizers()
                bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
                o = order_of(bucket)
                edge = np.searchsorted(bucket[o], np.arange(buckets + 1))
                rows = [(k, row["batch"], pack(keys[o[edge[k] : edge[k + 1]]].astype(np.uint32)), pack(np.minimum(counts[o[edge[k] : edge[k + 1]]], 255).astype(np.uint8))) for k in range(buckets) if edge[k + 1] > edge[k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _ASK1)], schema=_ASK1)

    def count_minimizers(t: pa.Table) -> pa.Table:
        """Documents with each minimizer; its lower 32 bits and the bucket identify it, and a chance equality only makes a window travel in vain."""
        keys = [unpack(x, np.uint32) for x in t.column("keys").to_pylist()]
        counts = [unpack(x, np.uint8) for x in t.column("counts").to_pylist()]
        u, inv = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inv, np.concatenate(counts).astype(float))
        flag = (total >= 2).astype(np.uint8) + (total >= COMMON)
        flag, at, out = flag[inv].astype(np.uint8), 0, []
        for k in keys:
            out.append(pack(flag[at : at + len(k)]))
            at += len(k)
        n = len(out)
        return pa.Table.from_arrays([t.column("batch"), pa.array([1] * n, pa.int32()), t.column("bucket"), pa.array(out, pa.binary())], schema=_TELL)

    flags = stored(store.mapInArrow(ask_minimizers, "bucket int, batch long, keys binary, counts binary").groupBy("bucket").applyInArrow(count_minimizers, TELL), "minimizer_flags")
    release(spark)
    ask2 = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("texts", pa.binary()), ("lens", pa.binary()), ("docs", pa.binary()), ("parts", pa.binary())])

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in left.to_pylist():
            b = Batch(row)
            w = Windows(b)
            runs = w.runs(*_flags(b, w, buckets, right.to_pylist()))
            runs.distinct(b, buckets)
            edge = np.searchsorted(runs.bucket[runs.by_bucket], np.arange(buckets + 1)) if len(runs.start) else np.zeros(buckets + 1, int)
            for k in np.flatnonzero(np.diff(edge)):
                at = runs.by_bucket[edge[k] : edge[k + 1]]
                texts = [runs.texts[i] for i in at]
                rows.append((int(k), row["batch"], pack(np.frombuffer(b"".join(texts), np.uint8)), pack(np.array([len(t) for t in texts], np.uint32)), pack(runs.least[at]), pack(runs.part[at])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, ask2)], schema=ask2)

    def sort_windows(t: pa.Table) -> pa.Table:
        texts = np.concatenate([unpack(x, np.uint8) for x in t.column("texts").to_pylist()])
        lens = [unpack(x, np.uint32).astype(np.int64) for x in t.column("lens").to_pylist()]
        all_lens, all_docs = np.concatenate(lens), np.concatenate([unpack(x, np.int64) for x in t.column("docs").to_pylist()])
        part = np.concatenate([unpack(x, np.uint8) for x in t.column("parts").to_pylist()])
        first = np.concatenate([[0], np.cumsum(all_lens)[:-1]])
        base = np.concatenate([[0], np.cumsum(all_lens - LENGTH + 1)])
        hit = np.zeros(int(base[-1]), bool)
        pieces = min(256, max(1, -(-len(texts) // PIECE)))
        part = order_of(part % pieces), part % pieces
        edge = np.searchsorted(part[1][part[0]], np.arange(pieces + 1))
        for k in range(pieces):  # sorted one after the other, each by itself
            at = part[0][edge[k] : edge[k + 1]]
            if not len(at):
                continue
            n = all_lens[at]
            own = np.concatenate([[0], np.cumsum(n)])
            data = np.zeros(int(own[-1]) + 16, np.uint8)
            data[: own[-1]] = texts[np.repeat(first[at] - own[:-1], n) + np.arange(int(own[-1]))]
            windows = n - LENGTH + 1
            slot = np.concatenate([[0], np.cumsum(windows)])
            each = np.arange(int(slot[-1]))
            starts = np.repeat(own[:-1] - slot[:-1], windows) + each
            doc = np.repeat(all_docs[at], windows)
            group = repeated_windows(data, starts)
            least = np.full(int(group.max()) + 1, NONE, np.int64)
            np.minimum.at(least, group, doc)
            hit[np.repeat(base[at] - slot[:-1], windows) + each] = least[group] < doc
        out, at = [], 0
        for x in lens:
            n = int((x - LENGTH + 1).sum())
            out.append(pack(np.packbits(hit[at : at + n])))
            at += n
        return pa.Table.from_arrays([t.column("batch"), pa.array([2] * len(out), pa.int32()), t.column("bucket"), pa.array(out, pa.binary())], schema=_TELL)

    asked = store.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(ask_windows, "bucket int, batch long, texts binary, lens binary, docs binary, parts binary")
    hits = stored(asked.groupBy("bucket").applyInArrow(sort_windows, TELL), "window_hits")
    release(spark)
    done = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in left.to_pylist():
            b = Batch(row)
            w = Windows(b)
            answers = right.to_pylist()
            runs = w.runs(*_flags(b, w, buckets, [a for a in answers if a["step"] == 1]))
            runs.distinct(b, buckets)
            edges = np.zeros(len(b.data) + 1, np.int32)  # +1 where a removed string starts, -1 where it ends
            if len(runs.start):
                n_win = np.array([len(t) - LENGTH + 1 for t in runs.texts], np.int64)
                slot = np.concatenate([[0], np.cumsum(n_win)])
                bits = np.zeros(int(slot[-1]), bool)
                edge = np.searchsorted(runs.bucket[runs.by_bucket], np.arange(buckets + 1))
                for a in answers:
                    if a["step"] == 2:
                        at = runs.by_bucket[edge[a["bucket"]] : edge[a["bucket"] + 1]]
                        total = int(n_win[at].sum())
                        got = np.unpackbits(unpack(a["answer"], np.uint8))[:total].astype(bool)
                        where = np.repeat(slot[at] - np.concatenate([[0], np.cumsum(n_win[at])[:-1]]), n_win[at]) + np.arange(total)
                        bits[where] = got
                # of equal strings in a batch, those of greater ids are repeats whatever the answer is
                later = runs.ids > runs.least[runs.name]
                total = np.concatenate([[0], np.cumsum(runs.windows)])
                lo = 0
                while lo < len(runs.start):  # as many runs as make about PIECE windows
                    hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PIECE, side="right")) - 1)
                    n = runs.windows[lo:hi]
                    offs = np.arange(int(n.sum())) - np.repeat(total[lo:hi] - total[lo], n)
                    hit = bits[np.repeat(slot[runs.name[lo:hi]], n) + offs] | np.repeat(later[lo:hi], n)
                    p = (np.repeat(runs.start[lo:hi], n) + offs)[hit]
                    edges[p] += 1  # a window is in one run
                    edges[p + LENGTH] -= 1
                    lo = hi
            gone = np.cumsum(edges[:-1]) > 0
            for i, name in enumerate(b.ids):
                lo, hi = int(b.offsets[i]), int(b.offsets[i + 1])
                g = gone[lo:hi]
                n = int(g.sum())
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
                rest = b.data[lo:hi][~g] if n else b.data[lo:hi]
                rows.append((name, hi - lo, n, spans, hashlib.sha256(rest.tobytes()).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, done)], schema=done)

    out = stored(store.groupBy("batch").cogroup(flags.unionByName(hits).groupBy("batch")).applyInArrow(mark, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "substring_dedup")
    discard(store), discard(flags), discard(hits)
    release(spark)
    return out
