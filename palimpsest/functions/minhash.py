"""MinHash signatures of word shingles, and their bands.

h is the first 32 bits of a shingle's MD5 modulo the prime 2^31 - 1; the
permutation i is (a_i h + b_i) modulo the same prime.  Products stay below 2^62.
The constants follow from a multiplicative rule, so that SQL can use them too.
Signatures are computed over Arrow batches: 128 minima for each text are a
matrix operation, for which lambda functions in the JVM are interpreted one
element at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.config import DEFAULTS, Settings

PRIME = (1 << 31) - 1


def permutations(n: int) -> list[tuple[int, int]]:
    """n pairs (a, b) below the prime, a > 0: successive powers of 48271."""
    x, out = 20260, []
    for _ in range(n):
        a = x = x * 48271 % PRIME
        x = x * 48271 % PRIME
        out.append((a, x))
    return out


#: Shingles that go through all permutations at once, and through MD5: few enough for the processor's cache.
BLOCK, DIGESTED = 128, 4096
#: Longer shingles, in bytes, go through hashlib one by one.
LONG = 183
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_step(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """MD5's state after one more block of each message: ``words`` has a row for each of a block's 16 words."""
    a, b, c, d = state
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        f += words[g]
        left = _TURNS[turn][i % 4]
        high = f << np.uint32(left)
        f >>= np.uint32(32 - left)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return [x + y for x, y in zip(state, (a, b, c, d))]


def md5_heads(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each stretch of a text, of many stretches at once."""
    out, sizes = np.empty(len(starts), np.uint32), ends - starts
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.md5(text[starts[i] : ends[i]]).digest()[:4], "big")
    points, blocks = np.frombuffer(text + bytes(LONG + 72), np.uint8), (sizes + 72) // 64
    for n in range(1, (LONG + 72) // 64 + 1):
        own = np.flatnonzero((blocks == n) & (sizes <= LONG))
        for k in range(0, len(own), DIGESTED):
            at = own[k : k + DIGESTED]
            message = np.lib.stride_tricks.sliding_window_view(points, 64 * n)[starts[at]]
            message *= np.arange(64 * n, dtype=np.uint8) < sizes[at, None].astype(np.uint8)
            message[np.arange(len(at)), sizes[at]] = 0x80
            message[:, -8:] = (sizes[at] * 8).astype("<u8")[:, None].view(np.uint8)
            words, state = np.ascontiguousarray(message.view("<u4").T), [np.full(len(at), x, np.uint32) for x in _START]
            for j in range(n):
                state = _md5_step(state, words[16 * j : 16 * (j + 1)])
            out[at] = state[0].byteswap()
    return out


def shingle_hashes(texts: list[list[str]], size: int) -> list[np.ndarray]:
    """Of each text, given as words, h of its shingles.  A shingle is a stretch of the joined words."""
    own = [[w.encode() for w in words] for words in texts]
    spans, at = [], 0
    for words in own:
        ends = at + np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
        n = max(len(words) - size + 1, 0)
        spans.append((np.concatenate([[at], ends + 1])[:n], ends[size - 1 :]))
        at = int(ends[-1]) + 1 if words else at
    heads = md5_heads(b" ".join(b" ".join(words) for words in own if words), *(np.concatenate([x[k] for x in spans]).astype(np.int64) for k in (0, 1)))
    h = heads.astype(np.uint64) % np.uint64(PRIME)
    return np.split(h, np.cumsum([len(x[0]) for x in spans])[:-1])


def signatures(texts: list[list[str]], size: int, a: np.ndarray, b: np.ndarray) -> list[tuple[list[int], int] | None]:
    """Of each text, given as words, its signature and number of shingles; None if there is no shingle."""
    a, b = (x.astype(np.uint64)[:, None] for x in (a, b))
    wide, high = (np.empty((len(a), BLOCK), np.uint64) for _ in range(2))
    out = []
    for words, h in zip(texts, shingle_hashes(texts, size) if texts else []):
        least = np.full(len(a), PRIME, np.uint64)
        for i in range(0, len(h), BLOCK):
            part = h[i : i + BLOCK]
            x, y = wide[:, : len(part)], high[:, : len(part)]
            # 2^31 leaves 1, so both halves' sum, below twice the prime, leaves the same.
            np.add(np.multiply(a, part, out=x), b, out=x)
            np.right_shift(x, np.uint64(31), out=y)
            np.add(np.bitwise_and(x, np.uint64(PRIME), out=x), y, out=x)
            # Without a sign, what is less than the prime becomes large when that is taken off.
            np.minimum(x, np.subtract(x, np.uint64(PRIME), out=y), out=x)
            np.minimum(least, x.min(axis=1), out=least)
        out.append((least.tolist(), len(words) - size + 1) if len(h) else None)
    return out


def signature(words: list[str], size: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], int] | None:
    """One text's."""
    return signatures([words], size, a, b)[0]


#: Texts that a worker holds as Python objects at once, however many rows a batch has.
AT_ONCE = 128


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, without copying."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def clean_words_of(text: str, markers: Sequence[str]) -> list[str]:
    """The words of ``clean_text``, made where texts are Python's already: white space that it would collapse only divides words."""
    for m in markers:
        text = text.replace(m, " ")
    return text.lower().split()


def signed(batches: Iterator[pa.RecordBatch], size: int, a: np.ndarray, b: np.ndarray, markers: Sequence[str] = ()) -> Iterator[pa.RecordBatch]:
    """(id, sig, shingle_count, masked) of batches (id, text); texts with a marker, whatever its case, are masked."""
    low_markers = [m.lower() for m in markers]
    for batch in in_slices(batches):
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        signs = signatures([clean_words_of(t, markers) for t in texts], size, a, b)
        found = [(i, *s, any(m in low for m in low_markers)) for i, s, low in zip(ids, signs, map(str.lower, texts)) if s]
        if found:
            ids, sigs, counts, masked = zip(*found)
            columns = [pa.array(ids, pa.string()), pa.array(sigs, pa.list_(pa.int64())), pa.array(counts, pa.int32()), pa.array(masked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "sig", "shingle_count", "masked"])


def marked_fingerprints(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(id, sig, shingle_count, masked) of each document (id, extracted_text) that has a shingle."""
    size, markers = settings.shingle_words, tuple(settings.markers)
    a, b = (np.array(x) for x in zip(*permutations(settings.permutations)))
    return docs.select("id", "extracted_text").mapInArrow(lambda batches: signed(batches, size, a, b, markers), "id string, sig array<bigint>, shingle_count int, masked boolean")


def fingerprints(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(id, sig, shingle_count) of each document (id, extracted_text) that has a shingle."""
    return marked_fingerprints(docs, settings).drop("masked")


def bands(sig: Column, n_bands: int, rows: int) -> Column:
    """Array of (band, key) of a signature; the key is a hash of the band's values as numbers."""
    key = lambda k: F.xxhash64(*[F.get(sig, F.lit(i)) for i in range(k * rows, (k + 1) * rows)])
    return F.array(*[F.struct(F.lit(k).alias("band"), key(k).alias("key")) for k in range(n_bands)])


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
