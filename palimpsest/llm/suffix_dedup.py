"""Removal of long byte strings that occur more than once, by prefix-free parsing.

A rolling hash over the bytes of each text places triggers: the trigger of a
window of ``length`` bytes is the position with the least hash among the
first ``REACH`` positions of the window.  Triggers depend on content alone, so
equal windows have equal triggers at equal distances.  The windows that share a
trigger start next to each other; their starts are a phrase.

The corpus order is needed only as far as ``length`` bytes.  So a phrase stands
in it by two digests: that of what all its windows share (the order of the
dictionary) and that of all bytes its windows cover, which is the phrase with
the part of its parse's suffix that counts (the order of the parse).  Sorted by
both, equal strings are neighbours.  Phrases whose second digest has a
neighbour repeat entirely.  Phrases alone under the first digest do not repeat
anywhere.  The rest are the ends of repeats: they are cut into 16 phrases and
those again into single windows, and only for these the texts are read again.

Nothing but digests, positions and the edges' texts is shuffled, and the
number of rows is in proportion to the bytes.  Strings are compared by two
64-bit digests together (128 bits).

Passages of ``PASSAGE`` words are often shorter than ``length`` bytes.  The pipeline's stage
takes them out, too; ``remove_repeats`` removes bytes alone and counts them beside that.
A text's words then stand for its bytes, each by a 64-bit digest, and lengths, starts and
triggers count words; all else is the same.  Both kinds go through the same tables, the
places of words from ``WORDS_FROM`` on.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose
nothing; all copies of a repeated string go, the first included; rows that
share doc_id and text (repeated rows) are occurrences of their own, and get the
same verdict; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.names import free_names
from palimpsest.staging import drop, stage

LENGTH = 400
#: As the pipeline's stage takes it, in bytes, and the least words of a passage that it takes as well.
STAGE_LENGTH = 400
PASSAGE = 51
#: Bytes of a word's digest.
WORD = 8
#: Added to places that count words; no place in bytes is as large.
WORDS_FROM = 1 << 40
#: Positions among which the trigger of a window is chosen, and bytes of the rolling hash.
REACH, ROLL = 256, 8
#: Starts in one part of a phrase that is cut.
PART = 16
#: Window starts handled at once, and bytes of short texts handled together.
BLOCK, TOGETHER = 1 << 20, 1 << 21
#: Parts given back at once, or those of one text.
ROWS_TOGETHER = 1 << 16
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = np.uint64(21)  # bits for a place within a block
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NAMES = ("uid", "lo", "hi", "at", "shared", "full")
ROWS = ", ".join(f"{c} long" for c in NAMES)


def _reach(length: int, width: int = 1) -> int:
    return min(REACH // width, length - ROLL // width + 1)


def word_digests(text: bytes) -> bytes:
    """The digests of the words of a text."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.split()), "<u8").tobytes()


def phrases(text: bytes, length: int = LENGTH, ends: np.ndarray | None = None, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and trigger of each phrase; ``ends``: where the texts joined in ``text`` end.

    All are counted in units of ``width`` bytes: 1, or ``WORD`` for digests of words.
    """
    ends = np.array([len(text) // width]) if ends is None else ends
    reach, total, found = _reach(length, width), len(text) // width - length + 1, []
    for first in range(0, max(total, 0), BLOCK):
        m = min(BLOCK, total - first)
        n = m + reach - 1
        rolled = np.ndarray((n,), "<u8", text, first * width, (width,)) * MULTIPLIER
        # The place is in the low bits, so that of equal hashes the first one wins.
        key = (rolled >> LOW << LOW) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = key
        rows = padded.reshape(-1, reach)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:m], ahead[reach - 1 : reach - 1 + m])
        at = (least & ((np.uint64(1) << LOW) - np.uint64(1))).astype(np.int64) + first
        starts = np.arange(first, first + m)
        owner = np.searchsorted(ends, starts, side="right")
        inside = starts + length <= ends[np.minimum(owner, len(ends) - 1)]
        starts, at, owner = starts[inside], at[inside], owner[inside]
        if len(starts):
            cut = np.flatnonzero((at[1:] != at[:-1]) | (owner[1:] != owner[:-1])) + 1
            lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
            found.append((starts[lo], starts[hi], at[lo]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    lo, hi, at = map(np.concatenate, zip(*found))
    # A phrase that a block's end cut in two is one again: same trigger, and the starts follow each other.
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (lo[1:] != hi[:-1] + 1) | np.isin(lo[1:], ends)])
    return lo[new], hi[np.concatenate([new[1:], [True]])], at[new]


def digests(text: bytes, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, span: int, length: int, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each phrase, whose starts lie among the ``span`` positions up to ``at``: the digest of what
    all windows of such a phrase share, and that of all bytes that its own windows cover."""
    view, keep, digest = memoryview(text), length - span + 1, xxhash.xxh3_64_intdigest
    lo, hi, at = lo.tolist(), hi.tolist(), at.tolist()
    # Digests of bytes and of words have seeds of their own.
    shared = np.fromiter((digest(view[a * width : (a + keep) * width], width - 1) for a in at), np.uint64, len(at))
    kind = 1 + (width - 1 << 50)
    full = np.fromiter((digest(view[i * width : (j + length) * width], kind + (a - i << 20) + j - i) for i, j, a in zip(lo, hi, at)), np.uint64, len(at))
    return shared.view(np.int64), full.view(np.int64)


def _out(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts)], list(NAMES))


def _from(width: int) -> int:
    """What is added to the places of a kind."""
    return WORDS_FROM if width == WORD else 0


def _parse(kinds: list[tuple[int, int]]):
    """(uid, text) to one row for each phrase of each kind, which is a length and a width."""

    def solve(uids: list[int], texts: list[bytes], length: int, width: int) -> Iterator[pa.RecordBatch]:
        joined, ends = b"".join(texts), np.cumsum([len(t) // width for t in texts])
        lo, hi, at = phrases(joined, length, ends, width)
        if len(lo):
            shared, full = digests(joined, lo, hi, at, _reach(length, width), length, width)
            owner = np.searchsorted(ends, lo, side="right")
            base = np.concatenate([[0], ends])[owner] - _from(width)
            yield _out([(np.array(uids)[owner], lo - base, hi - base, at - base, shared, full)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, width in kinds:
                uids, texts, size = [], [], 0
                for uid, text in zip(b["uid"].to_pylist(), b["text"]):
                    text = text.as_py() or b""
                    if width == WORD:
                        text = word_digests(text)
                    if len(text) < length * width:
                        continue
                    uids.append(uid)
                    texts.append(text)
                    size += len(text)
                    if size >= TOGETHER:
                        yield from solve(uids, texts, length, width)
                        uids, texts, size = [], [], 0
                if uids:
                    yield from solve(uids, texts, length, width)

    return run


def _cut(kinds: list[tuple[int, int]], part: int):
    """Rows with a text and its undecided phrases to one row for each part of those: ``part`` starts, counted from the trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, n = [], 0
            for uid, raw, todo in zip(b["uid"].to_pylist(), b["text"], b["todo"]):
                raw, todo = raw.as_py(), todo.values
                every = np.stack([todo.field(c).to_numpy() for c in ("lo", "hi", "at")], axis=1)
                for length, width in kinds:
                    rows = every[(every[:, 0] >= WORDS_FROM) == (width == WORD)] - _from(width)
                    if not len(rows):
                        continue
                    text = word_digests(raw) if width == WORD else raw
                    # The first cut is of whole phrases, the second of parts.
                    at = rows[:, 2:] - np.arange(0, _reach(length, width) if part == PART else PART, part)
                    lo, hi = np.maximum(rows[:, :1], at - part + 1), np.minimum(rows[:, 1:2], at)
                    ok = lo <= hi
                    lo, hi, at = lo[ok], hi[ok], at[ok]
                    places = (x + _from(width) for x in (lo, hi, at))
                    parts.append((np.full(len(lo), uid), *places, *digests(text, lo, hi, at, part, length, width)))
                    n += len(lo)
                    if n >= ROWS_TOGETHER:
                        yield _out(parts)
                        parts, n = [], 0
            if parts:
                yield _out(parts)

    return run


def numbered(docs: DataFrame, uid: str = "uid") -> DataFrame:
    """The rows with a number of their own, written once: rows that are alike in all columns are told apart, too."""
    return stage(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("uid", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _decide(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(uid, lo, hi) of phrases that repeat entirely, and (uid, lo, hi, at) of what has to be looked at more closely.

    Very many phrases can share a digest: those of periodic text, the ends of a passage in most texts.  So rows are
    counted before they are dealt, first by what their windows share, then those that are not alone by both digests; what
    the counts say is joined to the rows from written tables, so that a digest with many rows is split among tasks.  Of
    copies one stands for all among the phrases that are like them without being equal: that with the least hash of its place.
    """
    place = F.xxhash64("uid", "lo")
    rows = stage(rows, f"{name}-rows")
    many = stage(rows.groupBy("shared").count().where("count > 1"), f"{name}-many")
    alike = stage(rows.join(many, "shared", "left_semi").select(*NAMES), f"{name}-alike")
    kinds = stage(alike.groupBy("shared", "full").agg(F.count("*").alias("copies"), F.min(place).alias("first")), f"{name}-kinds")
    mixed = stage(kinds.groupBy("shared").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-mixed")
    known = kinds.join(mixed, "shared", "left").select("shared", "full", F.expr("copies > 1").alias("repeats"), F.expr("n IS NOT NULL").alias("mixed"), "first")
    known = stage(known, f"{name}-known")
    found = alike.join(known, ["shared", "full"]).select("uid", "lo", "hi", "at", "repeats", (F.col("mixed") & (F.col("first") == place)).alias("open"))
    found = stage(found.where("repeats OR open"), name)
    drop(rows.sparkSession, rows, many, alike, kinds, mixed, known)
    return found.where("repeats").select("uid", "lo", "hi"), found.where("open").select("uid", "lo", "hi", "at")


def _repeats(rows: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """(uid, lo, hi) of all kinds; places that count words start at ``WORDS_FROM``."""
    found, todo = _decide(_texts(rows).mapInArrow(_parse(kinds), ROWS), "phrases")
    texts = _texts(rows)
    for part in (PART, 1):
        grouped = stage(todo.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi", "at")).alias("todo")), f"todo-{part}")
        parts = texts.join(grouped, "uid").select("uid", "text", "todo").mapInArrow(_cut(kinds, part), ROWS)
        more, todo = _decide(parts, f"phrases-{part}")
        drop(rows.sparkSession, grouped)
        found = found.unionByName(more)
    return found


def repeats(rows: DataFrame, length: int = LENGTH, width: int = 1) -> DataFrame:
    """(uid, lo, hi): the windows starting at lo..hi of the text of that uid have an equal one elsewhere; ``rows``: uid, text.

    With a ``width`` of ``WORD`` the windows are of ``length`` words, and lo and hi count words.
    """
    return _repeats(rows, [(length, width)]).select("uid", *((F.col(c) - _from(width)).alias(c) for c in ("lo", "hi")))


def _runs(lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The first place and the one after the last of each run that the windows of ``length`` starting at lo..hi cover; runs that touch are one."""
    if not len(lo):
        return []
    order = np.argsort(lo)
    first, after = lo[order], np.maximum.accumulate(hi[order] + length)
    new = first[1:] > after[:-1]
    return list(zip(first[np.concatenate([[True], new])].tolist(), after[np.concatenate([new, [True]])].tolist()))


def _strip(length: int, passage: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passages", "n_passage_words"]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()] + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(b["doc_id"].to_pylist(), b["text"], b["spans"]):
                text, cuts, passages, end, kept = text.as_py(), [], [], 0, []
                if spans.is_valid:
                    lo, hi = (spans.values.field(c).to_numpy() for c in ("lo", "hi"))
                    words = lo >= WORDS_FROM
                    cuts, passages = _runs(lo[~words], hi[~words], length), _runs(lo[words], hi[words], passage)
                for first, after in cuts:
                    kept.append(text[end:first])
                    end = after
                kept = b"".join([*kept, text[end:]])
                rows.append((doc_id, len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept, len(passages), sum(j - i for i, j in passages)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)

    return run


def _spans(rows: DataFrame, *kinds: tuple[int, int]) -> DataFrame:
    """(uid, spans) of the texts that lose something, written, so that its size is known to the join that follows."""
    return stage(_repeats(rows, list(kinds)).groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, n_passages, n_passage_words) for each row; kept: the remaining bytes.

    The last two count what stays unless it is removed as bytes: the words of a text that lie in ``passage`` words in a row
    which start anywhere else, too, whatever the white space between them, and the maximal runs of such words.
    """
    if length < ROLL:
        raise ValueError(f"length must be {ROLL} at least")
    if passage < 1:
        raise ValueError("passage must be 1 at least")
    rows = numbered(docs.select("doc_id", "text"))
    spans = _spans(rows, (length, 1), (passage, WORD))
    both = rows.select("uid", "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).join(spans, "uid", "left")
    return both.select("doc_id", "text", "spans").mapInArrow(
        _strip(length, passage),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passages long, n_passage_words long",
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words")


def _byte_spans(raw: bytes, spans: list[dict]) -> list[tuple[int, int]]:
    """The first byte and the one after the last of each repeat, in order; places from ``WORDS_FROM`` on count words."""
    out = [(x["lo"], x["hi"] + STAGE_LENGTH) for x in spans if x["lo"] < WORDS_FROM]
    if len(out) < len(spans):
        words = [m.span() for m in WORDS.finditer(raw)]
        passages = ((x["lo"] - WORDS_FROM, x["hi"] - WORDS_FROM) for x in spans if x["lo"] >= WORDS_FROM)
        out += [(words[lo][0], words[hi + PASSAGE - 1][1]) for lo, hi in passages]
    return sorted(out)


def _strip_text(columns: list[str], spans_name: str):
    """The rows with what is left of their texts; a character that a cut divides goes as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b["text"], b[spans_name]):
                text, spans, end, kept = text.as_py(), spans.as_py() or [], 0, []
                if spans:
                    raw = text.encode()
                    for first, after in _byte_spans(raw, spans):
                        if first > end:
                            kept.append(raw[end:first].decode(errors="ignore"))
                        end = max(end, after)
                    text = "".join([*kept, raw[end:].decode(errors="ignore")])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b[c] for c in columns], columns)

    return run


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of repeated strings of ``STAGE_LENGTH`` bytes and without repeated passages of
    ``PASSAGE`` words, whatever their length in bytes and the white space between them; n_chars follows the text."""
    uid, spans = free_names(docs.columns, "uid", "spans")
    rows = numbered(docs, uid)
    found = _spans(rows.select(F.col(uid).alias("uid"), "text"), (STAGE_LENGTH, 1), (PASSAGE, WORD))
    out = rows.join(found.select(F.col("uid").alias(uid), F.col("spans").alias(spans)), uid, "left")
    out = out.select(*docs.columns, spans).mapInArrow(_strip_text(docs.columns, spans), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
