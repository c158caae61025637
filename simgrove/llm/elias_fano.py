"""Token-id output with Elias-Fano document boundaries.

A segment file holds the ids of a run of documents, one after the other, and where each document ends. The ends are a rising
sequence in Elias-Fano form: low bits packed, high bits as unary gaps in a bitmap, with the place of every SAMPLE-th set bit as
the select structure: about 2 + log2(ids / documents) bits a document, and no table of 64-bit offsets. The ids are blocks of BLOCK
little-endian 16- or 32-bit numbers, each compressed, so that a document is read from its own blocks.

Segments are ranges of ascending doc_id; the manifest has each segment's first global offset.

Defined results: a null or empty text has the end id alone; a null doc_id comes before all others; repeated rows are written
side by side, ordered by text; an empty table gives no segment and an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simgrove.llm.common import n_partitions, scratch_path, stored
from simgrove.llm.shared_files import get, put

MAGIC, SAMPLE, BLOCK = b"EFTOK1\0\0", 256, 1 << 16
#: a segment is closed at so many ids; a longer document is a segment of its own
SEGMENT_IDS = 1 << 24
#: entries of each of a worker's two caches, some 200 bytes each at most for usual words
CACHE = 1_000_000


class EliasFano:
    """A rising sequence of n values, each below `universe`."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bitmap = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bitmap[ones] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(bitmap, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value i: from the nearest sampled set bit, bytes are counted forward to set bit i."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        if left:
            byte = at >> 3
            word = self.high[byte] & (0xFF << ((at & 7) + 1)) & 0xFF
            while (c := word.bit_count()) < left:
                left -= c
                byte += 1
                word = self.high[byte]
            for _ in range(left - 1):
                word &= word - 1
            at = (byte << 3) + (word & -word).bit_length() - 1
        low = 0
        first = i * self.low_bits
        for k in range(self.low_bits):
            low |= (self.low[(first + k) >> 3] >> ((first + k) & 7) & 1) << k
        return (at - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out += bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def dump(self) -> bytes:
        s = self.samples.astype("<u4").tobytes()
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(s)) + self.low + self.high + s

    @classmethod
    def load(cls, b: bytes, at: int) -> tuple["EliasFano", int]:
        n, low_bits, a, h, s = struct.unpack_from("<QBQQQ", b, at)
        at += struct.calcsize("<QBQQQ")
        low, high, samples = b[at : at + a], b[at + a : at + a + h], np.frombuffer(b, "<u4", s // 4, at + a + h)
        return cls(n, low_bits, low, high, samples), at + a + h + s


def segment_bytes(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> list[bytes]:
    ends = EliasFano.encode(np.cumsum(np.asarray(lengths, np.int64)))
    step = BLOCK * width
    pack = zstandard.ZstdCompressor(level=1)
    blocks = [pack.compress(ids[i : i + step]) for i in range(0, len(ids), step)]
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.packbits(np.array([d is None for d in doc_ids], np.uint8), bitorder="little").tobytes()
    names = zstandard.ZstdCompressor(level=3).compress(np.diff(names, prepend=0).astype("<i8").tobytes())
    head = MAGIC + struct.pack("<BQQQQ", width, len(doc_ids), len(ids) // width, len(names), len(blocks))
    return [head, np.array([len(b) for b in blocks], "<u4").tobytes(), names, nulls, ends.dump(), *blocks]


class Segment:
    """A segment file read back: document i's ids are those from select(i - 1) to select(i)."""

    def __init__(self, b: bytes):
        if b[:8] != MAGIC:
            raise ValueError("not a token segment")
        self.width, self.n_docs, self.n_ids, names, n_blocks = struct.unpack_from("<BQQQQ", b, 8)
        at = 8 + struct.calcsize("<BQQQQ")
        sizes = np.frombuffer(b, "<u4", n_blocks, at).astype(np.int64)
        at += 4 * n_blocks
        deltas = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[at : at + names]), "<i8")
        at += names
        null = np.unpackbits(np.frombuffer(b, np.uint8, (self.n_docs + 7) // 8, at), bitorder="little")[: self.n_docs]
        at += (self.n_docs + 7) // 8
        with np.errstate(over="ignore"):
            self.doc_ids = [None if z else int(d) for d, z in zip(np.cumsum(deltas), null)]
        self.ends, at = EliasFano.load(b, at)
        self.data, self.starts = b, at + np.concatenate([[0], np.cumsum(sizes)])
        self._held: tuple[int, bytes] = (-1, b"")

    def _block(self, k: int) -> bytes:
        if self._held[0] != k:
            self._held = (k, zstandard.ZstdDecompressor().decompress(self.data[self.starts[k] : self.starts[k + 1]], max_output_size=BLOCK * self.width))
        return self._held[1]

    def ids(self, first: int, end: int) -> np.ndarray:
        out = []
        while first < end:
            k, at = divmod(first, BLOCK)
            n = min(end - first, BLOCK - at)
            out.append(self._block(k)[at * self.width : (at + n) * self.width])
            first += n
        return np.frombuffer(b"".join(out), f"<u{self.width}")

    def document(self, i: int) -> tuple[int, int, np.ndarray]:
        first = self.ends.select(i - 1) if i else 0
        end = self.ends.select(i)
        return first, end, self.ids(first, end)


#: fixed value: the tokenizer's own division of text into pieces
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: fixed values: the normalizer and division into pieces of the tokenizers that can be asked piece by piece
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
DIVISION = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class CachedTokenizer:
    """The tokenizer, asked once for each piece of text between white space. A tokenizer with other rules than NORMALIZER and DIVISION, or without word ends, is given whole texts.

    Its pieces never reach over white space, so a text's ids are its pieces' ids in order. Pieces of Latin-1 text are looked up
    word by word and new words are encoded together; the ids of word ends tell them apart again. Other pieces are encoded as they stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        rules = json.loads(self.t.to_str())
        self.by_piece = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == DIVISION and rules["model"].get("end_of_word_suffix") == "</w>" and not rules["model"].get("dropout")
        vocab = self.t.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values(), default=0) < 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        special = [w.encode() for w, i in vocab.items() if w.startswith("<|")]
        # texts with a special token's name, or with white space that bytes.split and the tokenizer see differently, are encoded whole
        self.odd = [b"\xc2\x85", b"\xc2\xa0", b"\x1c", b"\x1d", b"\x1e", b"\x1f", *special]
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _plain(self, s: str) -> bytes:
        return np.array(self.t.encode(s, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn_words(self, new: list[str]) -> None:
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            ids = np.array(self.t.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, int)
            if len(cut) == len(part) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), (cut * self.width).tolist()
                self.words.update(zip(part, [raw[a:b] for a, b in zip([0, *at], at)]))
            else:
                for w in part:
                    self.words[w] = self._plain(w)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_piece:
            return [self._plain(t or "") for t in texts]
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        odd = [i for i, r in enumerate(raw) if any(map(r.__contains__, self.odd))]
        split = [r.split() for r in raw]
        for i in odd:
            split[i] = []
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        if len(self.words) > CACHE:
            self.words.clear()
        pieces = self.pieces
        new = list(set(chain.from_iterable(split)).difference(pieces))
        joined = b" ".join(new).decode("utf-8", "replace")
        if not joined.isascii() and max(joined) > "\xff":
            wide = [p for p in new if not p.isascii() and max(p.decode("utf-8", "replace")) > "\xff"]
            pieces.update((p, self._plain(p.decode("utf-8", "replace"))) for p in wide)
            new = list(set(new).difference(wide))
            joined = b" ".join(new).decode("utf-8", "replace")
        low = joined.lower().split(" ")
        whole = list(map(str.isalpha, low))  # one word, as most are
        alone = list(compress(low, whole))
        divided = [(p, [s[:-1], s[-1]] if s[-1] in ".," and s[:-1].isalpha() else PIECES.findall(s)) for p, s, w in zip(new, low, whole) if not w]
        self._learn_words(list(set(chain(alone, chain.from_iterable(ws for _, ws in divided))).difference(self.words)))
        ids = self.words.__getitem__
        pieces.update(zip(compress(new, whole), map(ids, alone)))
        pieces.update((p, b"".join(map(ids, ws))) for p, ws in divided)
        found = pieces.__getitem__
        out = [b"".join(map(found, parts)) for parts in split]
        for i in odd:
            out[i] = self._plain(texts[i])
        return out


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer_at(path: str) -> CachedTokenizer:
    """One tokenizer for each Python worker: what earlier tasks learnt stays known."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def write_segments(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes the segments and returns the manifest: segment, path, n_docs, n_ids, start (ids in all segments before)."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.repartitionByRange(n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, k = tokenizer_at(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], t.dtype).tobytes()
        names: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/segment-{part:06d}-{k:06d}.eft"
            put(path, segment_bytes(names, lengths, b"".join(held), t.width))
            return pa.RecordBatch.from_pydict({"part": [part], "k": [k], "path": [path], "n_docs": [len(names)], "n_ids": [size]}, schema=pa.schema([("part", pa.int32()), ("k", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                for name, ids in zip(piece.column("doc_id").to_pylist(), t.encode(piece.column("text").to_pylist())):
                    names.append(name)
                    held += (ids, end)
                    lengths.append(len(ids) // t.width + 1)
                    size += lengths[-1]
                    if size >= segment_ids:
                        yield close()
                        names, lengths, held, size, k = [], [], [], 0, k + 1
        if names:
            yield close()

    written = stored(d.mapInArrow(run, "part int, k int, path string, n_docs long, n_ids long"), "segments")
    order = W.orderBy("part", "k")  # one row a segment
    m = written.select(F.row_number().over(order).alias("segment"), "path", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("start"))
    return stored(m, "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Segment(get(r["path"]))
                ends = s.ends.all()
                firsts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                crc = [zlib.crc32(s.ids(int(f), int(e)).astype("<u4").tobytes()) for f, e in zip(firsts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(firsts + r["start"], pa.int64()), pa.array(ends - firsts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, n_partitions(manifest.sparkSession))
    return manifest.repartition(n, "segment").select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    return read_documents(write_segments(docs, tokenizer, folder or scratch_path(docs.sparkSession, "tokens"), end_id))
