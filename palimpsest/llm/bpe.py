"""Byte-level BPE encoding and decoding from a file of ranks.

The ranks become a model of the tokenizers library: bytes are written as
printable characters, and every way to split a token into two others is a merge
of that token's rank, so that the pair of least rank is always merged first.
Decoding reverses the byte table; the bytes are joined before they are read as
UTF-8, so a character that several ids share comes out whole.

Defined cases: null and empty texts have no ids; strings that look like special
tokens are ordinary text; ids outside the vocabulary raise; bytes that are not
UTF-8 can be decoded to bytes but raise when text is asked for; repeated rows
are encoded each for itself; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text that are encoded at once, and ids that are decoded at once; a longer text or list is alone.
TOGETHER, DECODED = 1 << 18, 1 << 18


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is visible in Latin-1, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encodes and decodes by a file of ranks and a pattern that splits texts first."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, shown = read_ranks(path), byte_characters()
        name = {token: "".join(map(shown.__getitem__, token)) for token in ranks}
        merges = [
            (name[token[:k]], name[token[k:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.bytes = token_bytes(path)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_with_offsets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's ids begin (and, last, end), all ids, and of each id the first character that it covers and the one after the last.

        The bytes of all ids of a text are its own bytes in order, so their sizes give each id's place in bytes; the bytes that
        start a character, counted up to there, give its place in characters.  An id with a part of a character covers all of it.
        """
        each = self.encode(texts)
        cuts = np.cumsum([0, *map(len, each)])
        ids = np.fromiter(itertools.chain.from_iterable(each), np.int32, cuts[-1])
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        characters = np.cumsum((raw & 0xC0) != 0x80)
        after = np.cumsum(self.sizes[ids])
        first = np.repeat(np.cumsum([0, *map(len, texts[:-1])]) if texts else [], np.diff(cuts))
        starts, ends = characters[after - self.sizes[ids]] - 1 - first, characters[after - 1] - first
        return cuts, ids, starts.astype(np.int32), ends.astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_workers: dict[tuple, ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _workers:
        _workers[path, pattern] = ByteBpe(path, pattern)
    return _workers[path, pattern]


_tokens: dict[str, dict[int, bytes]] = {}


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id, which is all that decoding needs."""
    if path not in _tokens:
        _tokens[path] = {rank: token for token, rank in read_ranks(path).items()}
    return _tokens[path]


def token_array(path: str) -> pa.Array:
    """The bytes of the id at each place; null where there is no such id."""
    tokens = token_bytes(path)
    return pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_binary())


def _joined(taken: pa.Array) -> pa.Buffer:
    if taken.null_count:
        raise KeyError("an id is not in the vocabulary")
    first, last = (int(np.frombuffer(taken.buffers()[1], np.int64)[taken.offset + k]) for k in (0, len(taken)))
    return taken.buffers()[2].slice(first, last - first) if last > first else pa.py_buffer(b"")


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch in groups of bounded size."""
    group, size = [], 0
    for text in column:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size > TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of a bounded number of ids."""
    ends, at = np.cumsum(pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(ends):
        after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODED, side="right")))
        yield batch.slice(at, after - at)
        at = after


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and, for each id, the first character of the text it covers and the one after the last."""
    p, q = (path or defaults()[0]), (pattern or defaults()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(p, q)
        for b in batches:
            at = 0
            for group in _groups(b["text"]):
                cuts, ids, starts, ends = bpe.encode_with_offsets(group)
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(group)), *lists], ["doc_id", "ids", "starts", "ends"])
                at += len(group)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the text of ids (null: empty), and of each row the columns ``also``."""
    p = path or defaults()[0]
    rows = encoded.select("doc_id", "ids", *(c for c in also if c != "ids"))
    schema = rows.select("doc_id", *also, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_array(p)
        for b in (part for batch in batches for part in _slices(batch)):
            lists = pa.array([x or [] for x in b["ids"].to_pylist()], b["ids"].type) if b["ids"].null_count else b["ids"]
            # The bytes of all ids in a row are the texts' bytes in a row; ids outside the vocabulary raise.
            taken = known.take(lists.flatten())
            size = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False))])
            cuts = pa.array(size[lists.offsets.to_numpy() - lists.offsets[0].as_py()], pa.int64())
            texts = pa.LargeStringArray.from_buffers(len(lists), cuts.buffers()[1], _joined(taken))
            texts.validate(full=True)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(b[c] for c in also), texts.cast(pa.string())], ["doc_id", *also, "text"])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to: what ``encode``, offsets included, and ``decode`` give.

    The ids go along through the decoding, the offsets end with the encoding that made them.
    """
    back = decode(encode(docs, path, pattern), path, ("ids",))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
