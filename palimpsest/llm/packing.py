"""Packing of documents into training sequences along a space-filling curve.

Tokenising gives each document the mean of its hashed tokens' projections, a
point of ``DIMS`` dimensions, whose place on a Hilbert curve is the sort key.
The ids go along, two bytes each where the vocabulary allows and compressed.
Rows are range-sorted by (key, doc_id) and packed in that order, each task for
itself: a document follows its predecessor without a gap, is cut wherever the
sequence is full, and goes on in the next one.  So every sequence has its full
length, but for the last one of each task.  ``pack`` gives the ids of each piece,
``sequences`` those of each sequence; digests are taken of the ids themselves.

Defined cases: a null text counts as empty (one piece: the end id alone);
repeated rows are packed each for itself; a null doc_id sorts first; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.staging import stage

LENGTH, END = 2048, 1
#: Hashed features of a document, dimensions of its point, bits of each on the curve.
FEATURES, DIMS, CURVE_BITS = 4096, 4, 15
#: Words whose ids a worker remembers.
REMEMBERED = 800_000
#: Tokens that a task packs, about; each task can leave one sequence unfilled.
TOKENS_A_TASK = 4_000_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words on which the normaliser does nothing but lower the case, and which fall into runs of letters, digits and runs of
#: other signs (the apostrophe starts endings of its own, so it is not among them); and those parts.  What a word may hold
#: is one flat choice by its first byte, so that matching never goes back.
_LETTERS, _SIGNS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+", rb"[!-&(-/:-@\[-`{-~]+"
_PLAIN = re.compile(rb"(?:[!-&(-@\[-~]|\xc3[\x9f-\xb6\xb8-\xbf])++")
_PARTS = re.compile(_LETTERS + b"|[0-9]|" + _SIGNS)


class Remembered(dict):
    """Computed values of keys.  Bounded: when the younger half is full, the older one goes."""

    def __init__(self, compute, size: int):
        self.compute, self.half, self.old = compute, max(1, size // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _number_bytes(numbers: list[int]) -> bytes:
    return struct.pack(f"<{len(numbers)}I", *numbers)


class WordIds:
    """The ids of white-space separated words, by the tokenizers library.

    No token crosses white space, so a text's ids are those of its words in
    order.  The ids of words and of their parts are remembered, in tables of
    bounded size.  The parts of plain words go straight to the library's model,
    other words through its whole chain of normaliser, splitter and model.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        #: Whether two bytes hold every id.
        self.narrow = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words, self.parts = Remembered(self._word, remembered), Remembered(self._part, remembered)

    def _part(self, part: bytes) -> bytes:
        text = part.decode("latin-1")
        if not part.isascii():
            text = text.translate(self.shown)
        return _number_bytes([t.id for t in self.model.tokenize(text)])

    def _word(self, word: bytes) -> bytes:
        if _PLAIN.fullmatch(word):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(word)))
        ids = self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids
        return _number_bytes(ids)

    def ids(self, text: bytes) -> bytes:
        """The ids of a text as little-endian 32-bit numbers; the tokenizer lowers the case of A-Z too."""
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_workers: dict[tuple, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def projection(size: int, features: int = FEATURES, dims: int = DIMS) -> np.ndarray:
    """A row for each id: that of its hashed feature, of random signs."""
    signs = np.random.default_rng(20).choice(np.array([-1, 1], np.float32), (features, dims))
    hashed = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return signs[(hashed % np.uint64(features)).astype(np.int64)]


def hilbert_key(points: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of nonnegative coordinates under 2^bits (transposed Gray code)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signs = _word_ids(path), None
        compress, narrow = zstandard.ZstdCompressor(level=1).compress, words.narrow
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            if signs is None:
                signs = projection(words.tokenizer.get_vocab_size(with_added_tokens=True))
            n_tokens, packed, hashes, points = [], [], [], []
            for text in b["text"]:
                ids = words.ids(text.as_py() or b"") + end
                n_tokens.append(len(ids) // 4)
                numbers = np.frombuffer(ids, "<u4")
                packed.append(compress(numbers.astype("<u2").tobytes() if narrow else ids))
                hashes.append(xxhash.xxh3_64_intdigest(ids) - (1 << 63))
                points.append(np.mean([signs[numbers[i : i + 65536]].sum(axis=0) for i in range(0, len(numbers), 65536)], axis=0) * (-(-len(numbers) // 65536)) / len(numbers))
            if not points:
                continue
            place = np.clip((np.array(points) + 1) / 2 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n_tokens, pa.int64()), pa.array(packed, pa.binary()), pa.array(hashes, pa.int64()), pa.array(hilbert_key(place))],
                ["doc_id", "doc_tokens", "packed", "ids_hash", "key"],
            )

    return run


#: Of a piece: its document, its place and length in it, all ids of the document, its sequence and place in that, its ids.
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
_PLACES = [c for c in PIECE if c not in ("ids_crc32", "ids")]
#: Bytes of ids handed on together.
TOGETHER = 1 << 22


def _pack(length: int, narrow: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unpack, sequence, used = zstandard.ZstdDecompressor().decompress, TaskContext.get().partitionId() << 32, 0
        rows, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*rows)), pa.array(ids, pa.binary())], [*_PLACES, "ids"])
            rows.clear()
            ids.clear()
            return out

        for b in batches:
            for doc_id, total, packed in zip(b["doc_id"].to_pylist(), b["doc_tokens"].to_pylist(), b["packed"]):
                own = unpack(packed.as_py())
                if narrow:
                    own = np.frombuffer(own, "<u2").astype("<u4").tobytes()
                at = 0
                while at < total:
                    n = min(total - at, length - used)
                    rows.append((doc_id, at, n, total, sequence, used))
                    ids.append(own[4 * at : 4 * (at + n)])
                    at, used, size = at + n, used + n, size + 4 * n
                    if used == length:
                        sequence, used = sequence + 1, 0
                    if size >= TOGETHER:
                        yield flush()
                        size = 0
        if rows:
            yield flush()

    return run


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, doc_tokens, packed, ids_hash, key): number of ids with the end id, the ids compressed and their hash, place on the curve."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_tokenise(path), "doc_id long, doc_tokens long, packed binary, ids_hash long, key long")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row for each piece, in the columns of ``PIECE``; ids: little-endian 32-bit numbers."""
    # Written once: the range sort reads its input twice, for bounds and for rows.
    path = path or vocabulary_path()
    rows = stage(tokenised(docs, path), "tokenised")
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    parts = -(-total // TOKENS_A_TASK) or 1
    # The hash tells rows with equal keys and different ids apart, so the order is the same in every run; it does so
    # in few bytes, as the driver gets a sample of what is ordered by.
    order = ["key", "doc_id", "doc_tokens", "ids_hash"]
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pieces = laid.mapInArrow(_pack(length, _word_ids(path).narrow), ", ".join(f"{c} long" for c in _PLACES) + ", ids binary")
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(*PIECE)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids) of each sequence; ids: those of its pieces in order, little-endian 32-bit numbers."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), own.alias("own"))
    return rows.select("sequence_id", "n_ids", F.expr("aggregate(own, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
