"""A Katz backoff language model: Good-Turing discounted bigram counts with exactly normalised backoff weights.

Counts come from training documents; they are stored in tables partitioned by hash bucket: word counts, and for each context its
following words with their counts. A token is evaluated recursively: the discounted bigram if it was seen; else the context's backoff weight
times the word's own probability; unknown words share the mass that discounting takes from the words seen K_MAX times or less.

    p(w | h) = d(c(h, w)) c(h, w) / C(h)      if c(h, w) > 0
             = alpha(h) p(w)                   otherwise, alpha(h) = (1 - sum of the former over seen w) / (1 - sum of p(w) over seen w)
    (a context of which no count is discounted has C(h) + 1 in place of C(h), so that alpha is above 0)
    p(w)     = d1(c(w)) c(w) / N               if c(w) > 0, else the unknown words' share

Documents stay in packed batches. A batch asks hash buckets about its distinct words, then about its distinct bigrams, and the buckets count
and answer; a frequent context is spread over buckets by following word, and its sums are put together afterwards (at most 2 * buckets contexts are
frequent by definition). Hashes of 64 bits stand for the words; in bigrams a word is its rank by count in its bucket, times the number of buckets, plus
the bucket: a number that is small for frequent words and needs no further agreement.

Defined results: a null or empty text has the end token alone; a null id counts as the text '' in the fold and comes back null; without training documents all words are unknown,
train_tokens is 0 and the score is 0; repeated rows count as often as they occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import discard, mix64, n_partitions, scratch_path, stored, word_hashes, words_of, write_table
from simgrove.llm.packed import Batch, batched, from_planes, order_of, pack, planes, release, unpack

K_MAX = 5
END, START = np.uint64(0x1D5EED0000000001), np.uint64(0x1D5EED0000000002)


def discounts(n_of: dict[int, int], k: int = K_MAX) -> list[float]:
    """d(1..k) by Good-Turing as Katz has it, 1 above k: from the counts of counts themselves, or where these don't allow it (a d outside 0 to 1, as when
    copied texts raise some n(r)) from their log-linear smoothing over all counts. Absolute discounting by n1 / (n1 + 2 n2) is left where the smoothed n(r) don't fall faster than 1 / r."""
    n = [n_of.get(r, 0) for r in range(k + 2)]
    if (d := _good_turing(n, k)) is None:
        d = _good_turing(smoothed(n_of, k), k)
    if d is not None:
        return d
    less = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    less = min(max(less, 0.1), 0.9)
    return [1 - less / r for r in range(1, k + 1)]


def _good_turing(n: list[float], k: int) -> list[float] | None:
    if not all(n[1 : k + 2]):
        return None
    cut = (k + 1) * n[k + 1] / n[1]
    if not 0 <= cut < 1:
        return None
    d = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) for r in range(1, k + 1)]
    return d if all(0 < x < 1 for x in d) else None


def smoothed(n_of: dict[int, int], k: int = K_MAX) -> list[float]:
    """n(0..k+1) on the line log n = a + b log r. It is fitted to each count's n(r) averaged over the gap to its neighbours (Gale and Sampson), weighted by n(r); zeros without a word of count 1 or a second count."""
    r = np.array(sorted(r for r, m in n_of.items() if r > 0 and m > 0), float)
    if len(r) < 2 or r[0] > 1:
        return [0.0] * (k + 2)
    m = np.array([n_of[int(x)] for x in r], float)
    below, above = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
    x, y = np.log(r), np.log(2 * m / (above - below))
    x0, y0 = np.average(x, weights=m), np.average(y, weights=m)
    slope = float((m * (x - x0) * (y - y0)).sum() / (m * (x - x0) ** 2).sum())
    return [0.0, *(float(np.exp(y0 + slope * (np.log(q) - x0))) for q in range(1, k + 2))]


@dataclass
class Words:
    """The unigram level: N tokens, V distinct, discounts; probabilities of counts."""

    n: int
    v: int
    d: list[float]
    unknown: float

    @classmethod
    def fit(cls, n: int, v: int, n_of: dict[int, int]) -> "Words":
        d = discounts(n_of)
        unknown = sum((1 - d[r - 1]) * r * n_of.get(r, 0) for r in range(1, K_MAX + 1)) / n if n else 1.0
        if n and unknown <= 0:  # no rare words: one token's worth for the unknown, from all alike
            d, unknown = [n / (n + 1)] * K_MAX, 1 / (n + 1)
            return cls(n + 1, v, [1.0] * K_MAX, unknown)
        return cls(n, v, d, unknown)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c, float)
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, discounted(c, self.d) / self.n, self.unknown)


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    f = np.ones(K_MAX + 2)
    f[1 : K_MAX + 1] = d
    return np.asarray(c, float) * f[np.minimum(c, K_MAX + 1).astype(np.int64)]


class Tokens:
    """A batch's tokens: distinct hashes `u`, each token's place in u, its document; the start context is in u as well."""

    def __init__(self, b: Batch):
        start, end, doc = words_of(b.data, b.offsets)
        h = word_hashes(b.data, start, end)
        n_docs = len(b.ids)
        count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
        self.lengths = count + 1
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if n_docs else np.zeros(0, np.int64)
        total = int(self.lengths.sum())
        t = np.full(total, END, np.uint64)
        t[np.arange(len(h)) + doc] = h  # each earlier document adds one end token
        self.doc = np.repeat(np.arange(n_docs), self.lengths)
        self.u, inv = np.unique(np.append(t, START), return_inverse=True)
        self.at, self.start_at = inv[:-1], inv[-1]
        self.context = np.empty(total, np.int64)
        self.context[1:] = self.at[:-1]
        self.context[self.first] = self.start_at
        self.learn = np.repeat(b.fold(7) != 2, self.lengths)


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    o = order_of(bucket)
    return o, np.searchsorted(bucket[o], np.arange(buckets + 1))


def _word_bucket(u: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(u) % np.uint64(buckets)).astype(np.int64)


def _word_counts(t: Tokens, buckets: int, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and numbers of the batch's distinct words."""
    out, number = np.zeros(len(t.u), np.int64), np.zeros(len(t.u), np.uint64)
    o, edge = _dealt(_word_bucket(t.u, buckets), buckets)
    for a in answers:
        at = o[edge[a["bucket"]] : edge[a["bucket"] + 1]]
        x, y = _parts(a["answer"], 2)
        out[at] = from_planes(x)
        number[at] = from_planes(y) * np.uint64(buckets) + np.uint64(a["bucket"])
    return out, number


def _joined(parts: list[bytes]) -> bytes:
    return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)


def _parts(b: bytes, n: int) -> list[bytes]:
    at = np.concatenate([[8 * n], 8 * n + np.cumsum(np.frombuffer(b, "<u8", n).astype(np.int64))])
    return [b[at[i] : at[i + 1]] for i in range(n)]


class Bigrams:
    """A batch's distinct bigrams by bucket; contexts with counts above n / (2 * buckets) are spread."""

    def __init__(self, t: Tokens, counts: np.ndarray, n: int, buckets: int):
        key = (t.context.astype(np.uint64) << np.uint64(32)) | t.at.astype(np.uint64)
        self.key, self.at = np.unique(key, return_inverse=True)
        self.ctx, self.w = (self.key >> np.uint64(32)).astype(np.int64), (self.key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.train = np.bincount(self.at, t.learn, minlength=len(self.key)).astype(np.int64)
        c = counts.copy()
        c[t.start_at] = counts[np.searchsorted(t.u, END)] if len(t.at) else 0
        spread = np.maximum(1, -(-c * 2 * buckets // max(1, n)))
        spread = np.where(spread > 1, np.minimum(spread, buckets), 1)
        self.frequent = spread > 1
        with np.errstate(over="ignore"):
            salt = (mix64(t.u[self.w] + np.uint64(7)) % spread[self.ctx].astype(np.uint64)).astype(np.uint64)
            bucket = (mix64(t.u[self.ctx] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
        self.order, self.edge = _dealt(bucket, buckets)


def _contexts(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of equal contexts, and the runs' lengths."""
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(ctx)))


TELL = "kind string, batch long, bucket int, answer binary"
_TELL = pa.schema([("kind", pa.string()), ("batch", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _sums(c: np.ndarray) -> bytes:
    """A bucket's total and number of counts above 0, and its counts of counts: a count of N tokens has at most sqrt(2 N) different values."""
    c = c[c > 0]
    r, m = np.unique(c, return_counts=True)
    return _joined([pack(np.array([c.sum(), len(c)], np.int64)), planes(r), planes(m)])


def fit_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_model: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    buckets = n_partitions(spark)
    store = batched(docs, doc_id, text)
    ask1 = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def ask_words(batches):
        for rb in batches:
            for row in rb.to_pylist():
                t = Tokens(Batch(row))
                c = np.bincount(t.at, t.learn, minlength=len(t.u)).astype(np.uint32)
                o, edge = _dealt(_word_bucket(t.u, buckets), buckets)
                rows = [(k, row["batch"], pack(t.u[o[edge[k] : edge[k + 1]]]), pack(c[o[edge[k] : edge[k + 1]]])) for k in range(buckets) if edge[k + 1] > edge[k]]
                yield from _table(rows, ask1).to_batches()

    def count_words(t: pa.Table) -> pa.Table:
        keys = [unpack(x, np.uint64) for x in t.column("keys").to_pylist()]
        u, inv = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(inv, np.concatenate([unpack(x, np.uint32) for x in t.column("counts").to_pylist()])).astype(np.int64)
        bucket = t.column("bucket")[0].as_py()
        rows, at = [], 0
        rank = np.empty(len(u), np.uint64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(u), dtype=np.uint64)
        back, ranks = c[inv], rank[inv]
        for k, b in zip(keys, t.column("batch").to_pylist()):
            rows.append(("answer", b, bucket, _joined([planes(back[at : at + len(k)]), planes(ranks[at : at + len(k)])])))
            at += len(k)
        seen = c > 0
        rows.append(("words", None, bucket, _joined([pack(u[seen]), planes(c[seen]), planes(rank[seen])])))
        rows.append(("sums", None, bucket, _sums(c)))
        return _table(rows, _TELL)

    def stored_by_kind(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        write_table(df, path, ("kind",))
        out = spark.read.schema("batch long, bucket int, answer binary, kind string").parquet(path).select("kind", "batch", "bucket", "answer")
        out._simgrove_path = path
        return out

    def summed(df: DataFrame) -> tuple[int, int, dict[int, int]]:
        """The buckets' totals, numbers of distinct keys, and counts of counts."""
        n, v, n_of = 0, 0, Counter()
        for row in df.filter("kind = 'sums'").select("answer").collect():  # one a bucket
            x, y, z = _parts(row[0], 3)
            n, v = (a + int(b) for a, b in zip((n, v), unpack(x, np.int64)))
            for r, m in zip(from_planes(y).tolist(), from_planes(z).tolist()):
                n_of[int(r)] += int(m)
        return n, v, n_of

    words_table = stored_by_kind(store.mapInArrow(ask_words, "bucket int, batch long, keys binary, counts binary").groupBy("bucket").applyInArrow(count_words, TELL), "katz_words")
    release(spark)
    n, v, n_of = summed(words_table)
    words = Words.fit(n, v, n_of)
    answers1 = words_table.filter("kind = 'answer'")
    ask2 = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("contexts", pa.binary()), ("runs", pa.binary()), ("frequent", pa.binary()), ("ws", pa.binary()), ("own", pa.binary()), ("counts", pa.binary())])

    def ask_bigrams(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in left.to_pylist():
            t = Tokens(Batch(row))
            c, number = _word_counts(t, buckets, right.to_pylist())
            g = Bigrams(t, c, n, buckets)
            for k in np.flatnonzero(np.diff(g.edge)):
                at = g.order[g.edge[k] : g.edge[k + 1]]
                first, runs = _contexts(g.ctx[at])
                heads = g.ctx[at][first]
                rows.append((int(k), row["batch"], planes(number[heads]), planes(runs), pack(np.packbits(g.frequent[heads])), planes(number[g.w[at]]), planes(c[g.w[at]]), planes(g.train[at])))
        return _table(rows, ask2)

    def count_bigrams(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        heads = [from_planes(x) for x in t.column("contexts").to_pylist()]
        runs = [from_planes(x).astype(np.int64) for x in t.column("runs").to_pylist()]
        often = [np.unpackbits(unpack(x, np.uint8))[: len(h)].astype(bool) for x, h in zip(t.column("frequent").to_pylist(), heads)]
        ctxs, ctx = np.unique(np.concatenate(heads), return_inverse=True)
        frequent = np.zeros(len(ctxs), bool)
        frequent[ctx[np.concatenate(often)]] = True
        ws = np.concatenate([from_planes(x) for x in t.column("ws").to_pylist()])
        own = np.concatenate([from_planes(x) for x in t.column("own").to_pylist()])
        counts = np.concatenate([from_planes(x) for x in t.column("counts").to_pylist()]).astype(np.int64)
        each = np.repeat(ctx, np.concatenate(runs))
        o = np.argsort((each.astype(np.uint64) << np.uint64(32)) | ws) if ws.max() < 1 << 32 else np.lexsort((ws, each))
        new = np.ones(len(o), bool)
        new[1:] = (each[o][1:] != each[o][:-1]) | (ws[o][1:] != ws[o][:-1])
        pair = np.empty(len(o), np.int64)
        pair[o] = np.cumsum(new) - 1
        total = np.bincount(pair, counts).astype(np.int64)
        lead = o[new]
        seen = total > 0
        c, e = total[seen], each[lead][seen]
        sums = np.stack([np.bincount(e, c, minlength=len(ctxs)).astype(np.int64), *(np.bincount(e, c == r, minlength=len(ctxs)).astype(np.int64) for r in range(1, K_MAX + 1))])
        mass = np.bincount(e, words.p(own[lead][seen]), minlength=len(ctxs))
        rows, at, h_at = [], 0, 0
        back = total[pair]
        for h, r, b in zip(heads, runs, t.column("batch").to_pylist()):
            m = int(r.sum())
            x = ctx[h_at : h_at + len(h)]
            # counts in the order asked; then for each context its sums and its seen words' mass
            rows.append(("answer", b, bucket, _joined([planes(back[at : at + m]), planes(sums[:, x].ravel()), pack(mass[x])])))
            at, h_at = at + m, h_at + len(h)
        first, lens = _contexts(e)
        rows.append(("bigrams", None, bucket, _joined([planes(ctxs[e[first]]), planes(lens), planes(ws[lead][seen]), planes(c)])))
        rows.append(("sums", None, bucket, _sums(c)))
        f = np.flatnonzero(frequent)
        if len(f):
            rows.append(("frequent", None, bucket, _frequent_rows(ctxs[f], sums[:, f], mass[f])))
        return _table(rows, _TELL)

    asked = store.groupBy("batch").cogroup(answers1.groupBy("batch")).applyInArrow(ask_bigrams, "bucket int, batch long, contexts binary, runs binary, frequent binary, ws binary, own binary, counts binary")
    bigrams_table = stored_by_kind(asked.groupBy("bucket").applyInArrow(count_bigrams, TELL), "katz_bigrams")
    release(spark)
    d = discounts(summed(bigrams_table)[2])
    frequent: dict[int, tuple[np.ndarray, float]] = {}
    for r in sorted(bigrams_table.filter("kind = 'frequent'").select("bucket", "answer").collect()):  # at most 2 * buckets contexts
        a = np.frombuffer(r["answer"], np.float64).reshape(K_MAX + 3, -1)
        for j, h in enumerate(a[0].view(np.uint64).tolist()):
            had = frequent.get(h, (np.zeros(K_MAX + 1), 0.0))
            frequent[h] = (had[0] + a[1 : K_MAX + 2, j], had[1] + a[K_MAX + 2, j])
    done = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = Batch(row)
            if not b.ids:
                continue
            t = Tokens(b)
            answers = right.to_pylist()
            c, number = _word_counts(t, buckets, [a for a in answers if a["kind"] == "answer"])
            g = Bigrams(t, c, n, buckets)
            count = np.zeros(len(g.key), np.int64)
            sums, mass = np.zeros((K_MAX + 1, len(t.u))), np.zeros(len(t.u))
            for a in answers:
                if a["kind"] == "bigrams":
                    at = g.order[g.edge[a["bucket"]] : g.edge[a["bucket"] + 1]]
                    x, y, z = _parts(a["answer"], 3)
                    count[at] = from_planes(x)
                    heads = g.ctx[at][_contexts(g.ctx[at])[0]]
                    sums[:, heads] = from_planes(y).reshape(K_MAX + 1, -1)
                    mass[heads] = unpack(z, np.float64)
            for h in np.flatnonzero(g.frequent):
                if (whole := frequent.get(int(number[h]))) is not None:
                    sums[:, h], mass[h] = whole
            own = words.p(c)
            # a context's discounted mass: all its counts, less what the rare ones lose
            lost = sum((1 - d[r - 1]) * r * sums[r] for r in range(1, K_MAX + 1))
            # where no count is rare nothing is lost: one count's worth is put aside for the other words
            whole_count = sums[0] + (lost <= 0)
            lost = np.where(lost > 0, lost, 1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = np.where(sums[0] > 0, lost / whole_count / (1 - mass), 1.0)
                p = np.where(count > 0, discounted(count, d) / whole_count[g.ctx], alpha[g.ctx] * own[g.w])
            score = np.add.reduceat(np.log10(p)[g.at], t.first)
            base = np.add.reduceat(np.log10((c[t.at] + 1) / (n + v + 1.0)), t.first)
            known = np.add.reduceat((c[t.at] > 0).astype(np.int64), t.first)
            out += list(zip(b.ids, (b.fold(7) == 2).tolist(), t.lengths.tolist(), known.tolist(), [n] * len(b.ids), base.tolist(), score.tolist()))
        return _table(out, done)

    answers2 = bigrams_table.filter("kind = 'answer'").withColumn("kind", F.lit("bigrams"))
    scored = store.groupBy("batch").cogroup(answers1.unionByName(answers2).groupBy("batch")).applyInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    scored = stored(scored, "katz_scores")
    discard(store)
    if not keep_model:
        discard(words_table), discard(bigrams_table)
    release(spark)
    return scored


def _frequent_rows(ctxs: np.ndarray, sums: np.ndarray, mass: np.ndarray) -> bytes:
    return np.concatenate([ctxs.view(np.float64)[None], sums.astype(np.float64), mass[None]]).tobytes()
