"""Toxicity by compression distance.

Two zstandard dictionaries are made, one of ordinary text and one of the toxic passages of toxic text: the words whose
beginnings stand out in toxic documents. (Dictionaries of whole texts tell little here: a few toxic words lie in long ordinary prose, so that of sf0.1's
training documents 76 % of the toxic ones and 43 % of the others have a window above the best threshold.) A window is one word (a few characters from each place where words are not spaced or
longer than LONG bytes), repeated REPEAT times so that a short word shows in whole bytes,
compressed once with each dictionary. A calibrated table turns (word length, ordinary length, toxic length) into the
log-likelihood ratio with which training documents of either label hold such a window. A document's score is a logistic function of
the sum over its different windows, fitted on the training rows.

The model is fitted on a bounded sample of labelled rows (MAX_TOXIC and MAX_ORDINARY rows, those whose hashed ids are smallest), in one
task, which holds the sample's words and not its texts; the driver gets the model. Scoring reads every whole text. Labels, language, source and id never enter a score.

Defined results: a null or empty text gets the score of a text without toxic windows; a null id is in the fold of the text '' and never learnt from; null labels are not
learnt from; an id with several labels counts as toxic if one says so; without labels of both kinds every score is the share of toxic labels (0 without labels);
repeated rows each get a row; a very long text is scored whole, in memory for its different words; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import chunks, fold_of

MAX_TOXIC, MAX_ORDINARY = 2000, 4000
REPEAT, GRAMS = 4, (4, 5, 6, 7, 8)
TOXIC_BYTES, ORDINARY_BYTES = 32768, 32768
#: windows kept in a worker's memory between texts
CACHE = 500_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: spaces and punctuation beyond ASCII in UTF-8: Latin-1 (soft hyphen and letters aside), U+2000 to U+206F without joiners, CJK and full-width punctuation
BREAK = re.compile(
    rb"\xc2[\x80-\xa9\xab\xac\xae-\xb4\xb6-\xb9\xbb-\xbf]|\xe2(?:\x80[\x80-\x8b\x8e-\xbf]|\x81[\x80-\x9f\xa1-\xaf])"
    rb"|\xe3\x80[\x80-\x84\x88-\xbf]|\xef(?:\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xbd[\x80\x9b-\xa5])"
)
#: scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana and Han
UNSPACED = re.compile(
    rb"(?:\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe3(?:\x80[\x85-\x87]|[\x81-\x83\x90-\xbf][\x80-\xbf])|[\xe4-\xe9][\x80-\xbf]{2}"
    rb"|\xef(?:[\xa4-\xab][\x80-\xbf]|\xbd[\xa6-\xbf]|\xbe[\x80-\x9f])|\xf0[\xa0-\xb3][\x80-\xbf]{2})+"
)
CHARACTER = re.compile(rb"[\x00-\x7f\xc0-\xff][\x80-\xbf]*")
#: words of more bytes are cut; characters of a cut window, in unspaced scripts and elsewhere
LONG, UNSPACED_N, LONG_N = 64, (2, 4), (6, 12)


def windows(text: str | None) -> set[bytes]:
    """The different words of a text, A-Z lower-cased. Unspaced scripts and words over LONG bytes become character n-grams from every place."""
    data = (text or "").encode("utf-8", "replace").lower()
    plain = data.isascii()
    out = set(WORD.findall(data if plain else BREAK.sub(b" ", data)))
    for w in [w for w in out if len(w) > LONG or not plain and UNSPACED.search(w)]:
        out.remove(w)
        at = 0
        for m in UNSPACED.finditer(w):
            _cut(w[at : m.start()], out)
            _grams(m.group(), UNSPACED_N, out)
            at = m.end()
        _cut(w[at:], out)
    return out


def _cut(word: bytes, out: set[bytes]) -> None:
    if len(word) > LONG:
        _grams(word, LONG_N, out)
    elif word:
        out.add(word)


def _grams(run: bytes, sizes: tuple[int, ...], out: set[bytes]) -> None:
    """n characters from each place to the run's end, fewer at the end: each place begins a window."""
    edge = [m.start() for m in CHARACTER.finditer(run)] + [len(run)]
    last = len(edge) - 1
    for n in sizes:
        out.update(run[edge[i] : edge[min(i + n, last)]] for i in range(last))


def _body(word: bytes) -> bytes:
    return (b" " + word) * REPEAT + b" "


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(
        compression_level=3, window_log=15, hash_log=13, chain_log=13, search_log=5, min_match=3,
        strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def _dictionary(words: list[bytes], ids: np.ndarray, size: int) -> bytes:
    """Dictionary content for windows of the words that ids name: all of them, commonest last (nearest), if they fit; else zstandard's trainer chooses."""
    pad = b"\n" * 16  # the last bytes of a dictionary are not indexed
    there, count = np.unique(ids, return_counts=True)
    there = there[np.lexsort((there, count))].tolist()
    plain = lambda: b"".join(_body(words[k]) for k in there)
    if sum(len(_body(words[k])) for k in there) <= size:
        return plain() + pad
    try:
        bodies: dict[int, bytes] = {}  # equal samples share their bytes
        samples = [bodies.get(k) or bodies.setdefault(k, _body(words[k])) for k in ids[:: max(1, len(ids) // 200_000)].tolist()]
        return zstandard.train_dictionary(size, samples).as_bytes() + pad
    except zstandard.ZstdError:
        return plain()[-size:] + pad


def _beginnings(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Of sorted words the numbers of their beginnings (with the space before) of GRAMS bytes, -1 where a word is shorter; and how many there are."""
    out, made = np.full((len(words), len(GRAMS)), -1, np.int32), 0
    for j, n in enumerate(GRAMS):
        last = None
        for k, w in enumerate(words):
            if n <= len(w) + 2:
                x = (w + b" ")[: n - 1]  # words are sorted, so equal beginnings follow each other
                if x != last:
                    last, made = x, made + 1
                out[k, j] = made - 1
    return out, made


def _held(docs: list[np.ndarray], of: np.ndarray, n: int) -> np.ndarray:
    """In how many documents (of word numbers) each of n things is, if word k has of[k]; -1 is none."""
    out = np.zeros(n, np.int64)
    for d in docs:
        here = np.unique(of[d])
        out[here[here >= 0]] += 1
    return out


def stand_out(toxic: list[np.ndarray], ordinary: list[np.ndarray], words: list[bytes]) -> np.ndarray:
    """Which of the sorted words begin (with the space before) in a way far likelier in toxic documents: a ratio of 8 or more, and more than chance gives."""
    of, n = _beginnings(words)
    many, few = _held(toxic, of, n), _held(ordinary, of, n)
    # chance: the log-likelihood ratio must exceed what the best of so many beginnings reaches by itself
    chance = 4 + math.log(int((many > 0).sum()) + 1)
    good = np.zeros(n + 1, bool)  # the last for -1
    for g in np.flatnonzero(many >= 3).tolist():
        c = int(many[g])
        a, b = c / len(toxic), (int(few[g]) + 0.5) / (len(ordinary) + 1)
        good[g] = a >= 8 * b and c * math.log(a / b) - c + b * len(toxic) >= chance
    return good[of].any(axis=1)


@dataclass
class Model:
    toxic: bytes = b" "
    ordinary: bytes = b" "
    table: dict[tuple[int, int, int], float] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -10.0

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """A model with its compressors; made once in each Python worker."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        self.short = {(k[0], k[2]) for k in model.table}
        self.with_toxic, self.with_ordinary = _compressor(model.toxic), _compressor(model.ordinary)

    def key(self, word: bytes) -> tuple[int, int, int]:
        x = _body(word)
        return len(word), len(self.with_ordinary.compress(x)), len(self.with_toxic.compress(x))

    def ratio(self, word: bytes) -> float:
        v = self.seen.get(word)
        if v is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            x = _body(word)
            n, t = len(word), len(self.with_toxic.compress(x))
            # the ordinary length is needed only where some window of the table has this toxic length
            v = self.model.table.get((n, len(self.with_ordinary.compress(x)), t), 0.0) if (n, t) in self.short else 0.0
            self.seen[word] = v
        return v

    def evidence(self, text: str | None) -> float:
        ratio = self.ratio
        return math.fsum(ratio(w) for w in windows(text))

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.evidence(text) + self.model.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _numbered(rows: Iterable[tuple[str | None, int]]) -> tuple[list[bytes], list[np.ndarray], list[int]]:
    """The different words of all rows, sorted; the words of each row as sorted numbers; the labels. Texts are not kept."""
    number: dict[bytes, int] = {}
    docs, labels = [], []
    for text, y in rows:
        docs.append(np.array([number.setdefault(w, len(number)) for w in windows(text)], np.int32))
        labels.append(1 if y else 0)
    words = sorted(number)
    rank = np.zeros(len(words), np.int32)
    rank[np.fromiter((number[w] for w in words), np.int64, len(words))] = np.arange(len(words), dtype=np.int32)
    return words, [np.sort(rank[d]) for d in docs], labels


def fit(rows: Iterable[tuple[str | None, int]]) -> Model:
    """rows: (text, label), read once. Deterministic. Of a text only the numbers of its words are held."""
    words, docs, labels = _numbered(rows)
    toxic, ordinary = ([d for d, y in zip(docs, labels) if y == kind] for kind in (1, 0))
    if not toxic or not ordinary:
        share = len(toxic) / max(1, len(docs))
        return Model(offset=30.0 if share == 1 else -30.0 if share == 0 else math.log(share / (1 - share)))
    standing, flat = stand_out(toxic, ordinary, words), np.concatenate(toxic)
    model = Model(toxic=_dictionary(words, flat[standing[flat]], TOXIC_BYTES), ordinary=_dictionary(words, np.concatenate(ordinary), ORDINARY_BYTES))
    s, keys = model.scorer(), {}
    kind = np.fromiter((keys.setdefault(s.key(w), len(keys)) for w in words), np.int32, len(words))
    many, few = _held(toxic, kind, len(keys)).tolist(), _held(ordinary, kind, len(keys)).tolist()
    for k, i in keys.items():
        a, b = (many[i] + 0.1) / (len(toxic) + 1), (few[i] + 0.5) / (len(ordinary) + 1)
        if k[1] > k[2] and many[i] >= 2 and a > 3 * b:
            model.table[k] = math.log(a / b)
    ratio = np.array([model.table.get(k, 0.0) for k in keys])
    model.slope, model.offset = _logistic([(math.fsum(ratio[kind[d]].tolist()), y) for d, y in zip(docs, labels)])
    return model


def _logistic(x: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset; the offset then moves so that the fewest training rows are on the wrong side of 0.5, errors of either label weighed alike where they tie."""
    slope, offset = 1.0, -2.0
    for _ in range(40):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for v, y in x:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * v + offset))))
            e, w = y - p, p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + e, g1 + e * v, h00 + w, h01 + w * v, h11 + w * v * v
        g0, g1, h00, h11 = g0 - 1e-2 * offset, g1 - 1e-2 * slope, h00 + 1e-2, h11 + 1e-2
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 2.0 / max(abs(d0), abs(d1), 1e-9))
        offset, slope = offset + step * d0, slope + step * d1
        if abs(d0) + abs(d1) < 1e-9:
            break
    slope = max(slope, 1e-3)
    values = sorted(x)
    wrong = sum(1 for _, y in values if not y)  # cut below everything: all are called toxic
    best, cut = wrong, values[0][0] - 1
    for i, (v, y) in enumerate(values):
        wrong += 1 if y else -1
        if (i + 1 == len(values) or values[i + 1][0] > v) and wrong < best:
            best, cut = wrong, (v + values[i + 1][0]) / 2 if i + 1 < len(values) else v + 1
    return slope, -slope * cut


def training_sample(docs: DataFrame, labels: DataFrame, fold: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The bounded sample (text, y), one partition in order of id and text: only rows outside the held-out fold."""
    l = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold_of(F.col(doc_id), fold) != 0)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("y"))
    h = F.xxhash64("doc_id")
    ids = l.filter("y > 0").orderBy(h, "doc_id").limit(MAX_TOXIC).unionByName(l.filter("y <= 0").orderBy(h, "doc_id").limit(MAX_ORDINARY))
    got = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")  # at most MAX_TOXIC + MAX_ORDINARY ids
    # ids can repeat: the bound is one of rows
    got = got.filter("y > 0").orderBy(h, "doc_id", "text").limit(MAX_TOXIC).unionByName(got.filter("y <= 0").orderBy(h, "doc_id", "text").limit(MAX_ORDINARY))
    return got.coalesce(1).sortWithinPartitions("doc_id", F.coalesce("text", F.lit(""))).select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[str | None, int]]:
    """The bounded sample brought to the driver."""
    return [(r["text"], r["y"]) for r in training_sample(docs, labels, fold, doc_id, text, label).collect()]


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = fit((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column("text"), b.column("y")))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def trained(sample: DataFrame) -> Model:
    """The model, fitted in one task: texts and words of the sample don't come to the driver."""
    got = sample.mapInArrow(_fit, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([])


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """Each document's doc_id, held_out, score, predicted; columns in keep come along."""
    model = trained(training_sample(docs, labels, fold, doc_id, text, label))
    keep = keep or []
    inner = docs.select(F.col(doc_id).alias("doc_id"), (fold_of(F.col(doc_id), fold) == 0).alias("held_out"), F.col(text).alias("simgrove_text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.scorer()
        for b in chunks(batches, "simgrove_text"):
            t = b.column("simgrove_text")
            scores = pa.array([s.score(t[i].as_py()) for i in range(b.num_rows)], pa.float64())
            names = ["doc_id", "held_out", *[f"kept_{i}" for i in range(len(keep))]]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], scores], names=[*names, "score"])

    fields = [f for f in inner.schema.fields if f.name != "simgrove_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    out = inner.mapInArrow(run, schema)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns kept."""
    kept = [f"k{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept)])
    ids = {c: k for c, k in zip(docs.columns, kept)}
    lab = labels.select(F.col("doc_id").alias(ids["doc_id"]), "toxic")
    s = score_documents(renamed, lab, doc_id=ids["doc_id"], text=ids["text"], keep=kept)
    return s.filter("predicted = 0").select(*[F.col(k).alias(c) for c, k in zip(docs.columns, kept)])
