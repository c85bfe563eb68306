"""Hierarchical Pitman-Yor language model over words.

A word sits in the restaurant of its context, the whole previous word (or the
start of a text).  All contexts share one parent, the restaurant of words without
history: each table of a context is a customer there.  Its base is uniform over
the V distinct trained words and one more, which stands for any other word.

Seatings are sampled by Gibbs.  A visit to a cell, the customers of one word in
one restaurant, takes out one of them at random and seats it again given all
others: at a table of the word with weight c - d t, or at a new one with weight
(theta + d T) times the parent's probability of the word.  Only the numbers c of
customers and t of tables are kept: given these, the chance that the customer
taken out sat alone is a ratio of generalised Stirling numbers (``alone``).  A
sweep visits every cell as many times as it has customers: in rounds, in which the
cells with customers to come are visited side by side with the table counts of the
last round, and, when these are few, one customer after the other (``in_turn``).  The
chain starts from a seating of the customers in turn (``seat``); after ``BURN`` sweeps
the tables expected of each visit of ``KEEP`` sweeps, given all other customers, are
averaged, and with them the predictive probabilities, which are linear in them.

Distribution.  Texts are read in blocks.  A first exchange gives every word a
number, small for frequent words, and its count.  Then a block's distinct pairs of
context and word are dealt by a hash of both, so that a context or a word that
holds much of the text is split among all owners.  An owner samples its cells with
what it has of the parent and of each context's tables, scaled to all owners; the averages are added up
over all owners by word and by context, the parent is sampled from the sums, and
owners get back the words' probabilities and the contexts' tables, give each block
the probabilities of its pairs, and blocks score their texts.  Blocks and owners
hold a bounded amount of text and pairs; their numbers grow with the corpus, and
so does what is gathered.  A block's messages are no more than its words or pairs.
Only five sums meet in the driver.

Defined cases: null and empty texts are one end token; rows are scored each for
itself, repeated rows count twice in training; a null doc_id is in training; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.staging import drop, stage

FOLDS, HELD_OUT = 5, 1
#: Discount and strength of the parent and of the contexts.
PARENT, CONTEXT = (0.8, 5.0), (0.8, 1.0)
BURN, KEEP = 2, 4
#: Cells from which on a round visits them side by side, and table counts for which chances are held ready.
SIDE, AHEAD = 48, 1024
#: Averaged tables are told in this part of a table.
UNITS = 64
#: Customers up to which the chance to sit alone is tabulated.
TABULATED = 128
#: Bytes of text in a block, and of all text for each owner.
BLOCK_BYTES, OWNER_BYTES = 16 << 20, 16 << 20
END = b""
#: Bits of a word's number.
WORD_BITS = 40


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


# --- messages ------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by the places of their bytes, which compresses small numbers well."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T for a in arrays]
    raw = b"".join(np.int64(x.size).tobytes() + x.tobytes() for x in planes)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(packed: bytes, *types: type) -> list[np.ndarray]:
    """The arrays packed, of these types."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(packed), 0, []
    for t in types:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, n, at + 8).reshape(np.dtype(t).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += 8 + n
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin that differ in a key from those before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _cuts(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(owner, first, last) of each owner that occurs in a sorted array."""
    first = np.flatnonzero(_runs(owner)) if len(owner) else np.empty(0, np.int64)
    return zip(owner[first].tolist(), first.tolist(), [*first[1:].tolist(), len(owner)])


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


MESSAGE = "source long, owner long, data binary"


# --- words ---------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _of_trained(doc_ids: list[int | None], sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.array([not held_out(d) for d in doc_ids], bool), sizes)


def block_words(number: int, doc_ids: list[int | None], texts: list[bytes], owners: int) -> Iterator[tuple]:
    """Rows of a block: its texts by the places of their words among its own (owner -1), and for each owner its words' hashes and counts."""
    known = _Numbers()
    known[END] = 0
    tokens = [[*map(known.__getitem__, words_of(t)), 0] for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    tokens = np.concatenate([np.array(t, np.int32) for t in tokens])
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    owner = (hashes % np.uint64(owners)).astype(np.int64)
    order = np.lexsort((hashes, owner))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    tokens, hashes = place[tokens], hashes[order]
    counts = np.bincount(tokens[_of_trained(doc_ids, sizes)], minlength=len(order))
    yield number, -1, _pack(np.array([d is None for d in doc_ids]), np.array([d or 0 for d in doc_ids], np.int64), sizes, tokens)
    for o, a, z in _cuts(owner[order]):
        yield number, o, _pack(np.diff(hashes[a:z], prepend=np.uint64(0)), counts[a:z])


def _count(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, doc_ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
                doc_ids.append(doc_id)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield from _table(list(block_words(number, doc_ids, texts, owners)), MESSAGE).to_batches()
                    doc_ids, texts, size, number = [], [], 0, number + 1
        if doc_ids:
            yield from _table(list(block_words(number, doc_ids, texts, owners)), MESSAGE).to_batches()

    return run


VOCABULARY = "source long, owner long, data binary, distinct long, trained long"


def _messages(table: pa.Table) -> list[tuple[int, bytes]]:
    return sorted(zip(table["source"].to_pylist(), table["data"].to_pylist()))


def _vocabulary(owners: int):
    """All blocks' words of an owner to their places by count and their counts, for each block, and the owner's sums (source -1)."""

    def run(table: pa.Table) -> pa.Table:
        own, parts = table["owner"][0].as_py(), []
        for block, data in _messages(table):
            steps, n = _unpack(data, np.uint64, np.int64)
            parts.append((block, np.cumsum(steps, dtype=np.uint64), n))
        _, which = np.unique(np.concatenate([h for _, h, _ in parts]), return_inverse=True)
        count = np.bincount(which, np.concatenate([n for *_, n in parts])).astype(np.int64)
        place = np.empty(len(count), np.int64)
        place[np.argsort(-count, kind="stable")] = np.arange(len(count))
        rows, at = [(-1, own, None, int((count > 0).sum()), int(count.sum()))], 0
        for block, h, _ in parts:
            w = which[at : at + len(h)]
            rows.append((block, own, _pack(place[w], count[w]), 0, 0))
            at += len(h)
        return _table(rows, VOCABULARY)

    return run


# --- pairs ---------------------------------------------------------------------------------


def _pair_owner(u: np.ndarray, w: np.ndarray, owners: int) -> np.ndarray:
    x = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(24)).astype(np.int64) % owners


def block_pairs(number: int, packed: bytes, words: list[tuple[int, bytes]], owners: int, trained: int, distinct: int) -> Iterator[tuple]:
    """Rows of a block: its texts by their places among its distinct pairs (owner -1), and for each owner its pairs, with counts.

    ``words``: for each owner of words the places and counts of this block's words.
    """
    null, doc_ids, sizes, tokens = _unpack(packed, bool, np.int64, np.int64, np.int32)
    told = [(o, *_unpack(x, np.int64, np.int64)) for o, x in sorted(words)]
    ids, count = np.concatenate([p * owners + o for o, p, _ in told]), np.concatenate([c for *_, c in told])
    by_id = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    ends = np.cumsum(sizes)
    # The end token is no context, so its place stands for the start of a text, a restaurant of its own.
    word = rank[tokens]
    before = np.concatenate([word[-1:], word[:-1]])
    pairs, pair = np.unique(before * len(ids) + word, return_inverse=True)
    u, w = pairs // len(ids), pairs % len(ids)
    learned = np.bincount(pair[_of_trained([None if x else d for x, d in zip(null, doc_ids.tolist())], sizes)], minlength=len(pairs))
    owner = _pair_owner(ids[by_id[u]], ids[by_id[w]], owners)
    order = np.argsort(owner, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # Each text's pairs in order, so that steps are small; a pair that it has twice is there twice.
    doc = np.repeat(np.arange(len(sizes)) * len(pairs), sizes)
    entries = np.sort(doc + place[pair]) - doc
    log_c, first = np.log10((count + 0.5) / (trained + 0.5 * (distinct + 1))), ends - sizes
    base, n_known = np.add.reduceat(log_c[tokens], first), np.add.reduceat((count > 0)[tokens].astype(np.int64), first)
    yield number, -1, _pack(null, doc_ids, sizes, n_known, base, np.diff(entries, prepend=0).astype(np.int32))
    u, w, owner, learned = u[order], w[order], owner[order], learned[order]
    for o, a, z in _cuts(owner):
        x, y, n = ids[by_id[u[a:z]]], ids[by_id[w[a:z]]], count[by_id[u[a:z]]]
        new = _runs(x)
        # Contexts and their counts once each; words in steps within a context.
        y = y - np.where(new, 0, np.concatenate([[0], y[:-1]]))
        yield number, o, _pack(new, np.diff(x[new], prepend=0), np.diff(n[new], prepend=0), y, learned[a:z].astype(np.int32))


def _pair_up(owners: int, trained: int, distinct: int):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([], MESSAGE)
        told = list(zip(words["owner"].to_pylist(), words["data"].to_pylist()))
        return _table(list(block_pairs(texts["source"][0].as_py(), texts["data"][0].as_py(), told, owners, trained, distinct)), MESSAGE)

    return run


# --- seatings ------------------------------------------------------------------------------


@functools.cache
def _alone_table(discount: float) -> np.ndarray:
    """Row c, column t, up to ``TABULATED``: S(c-1, t-1) / S(c, t) of the generalised Stirling numbers of that discount."""
    n = TABULATED
    log_s = np.full((n + 1, n + 1), -np.inf)
    log_s[1, 1] = 0.0
    t = np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, n):
            stay = np.where(t <= c, log_s[c] + np.log(np.maximum(c - discount * t, 0)), -np.inf)
            log_s[c + 1] = np.logaddexp(np.concatenate([[-np.inf], log_s[c, :-1]]), stay)
        out = np.zeros((n + 1, n + 1))
        out[1:, 1:] = np.nan_to_num(np.exp(log_s[:-1, :-1] - log_s[1:, 1:]))
    out[1, 1] = 1.0
    return out


@functools.cache
def _single_shares(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of the mean size of many tables, ascending, and the share of tables of one customer that goes with it.

    Sizes k of tables, given their mean, have chances in proportion to Gamma(k - d) / k! z^k; with z = 1 - e^-u both follow from u.
    """
    u = np.geomspace(1e-7, 200, 4096)
    z, norm = -np.expm1(-u), -np.expm1(-discount * u)
    return np.log(discount * z / norm) + (1 - discount) * u, discount * z / norm


def alone(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The chance that one of the customers, seated at so many tables, sits at its table alone.

    A table gives it exactly up to ``TABULATED`` customers; for more it is the limit of many tables, two per cent off at most there.
    """
    small = customers <= TABULATED
    out = np.empty(len(customers))
    out[small] = _alone_table(discount)[customers[small].astype(np.int64), tables[small].astype(np.int64)]
    c, t = customers[~small] - 1, tables[~small] - 1.0
    mean, share = _single_shares(discount)
    out[~small] = t / c * np.interp(np.log(c / np.maximum(t, 1e-3)), mean, share)
    return out


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Number of tables where each row's customers sit down in turn, in groups of an eighth of those present; ``new``: weight of a new table."""
    tables = np.minimum(customers, 1).astype(np.float64)
    order = np.argsort(-customers, kind="stable")
    sizes = -customers[order]  # ascending
    i = 1
    while (live := int(np.searchsorted(sizes, -i))) > 0:
        rows = order[:live]
        m = np.minimum(max(1, i // 8), customers[rows] - i)
        t, a = tables[rows], new[rows]
        p = a / (i + (m - 1) / 2 - discount * t + a)
        tables[rows] += rng.binomial(m, p)
        i += max(1, i // 8)
    return tables


def opens(customers: np.ndarray, left: np.ndarray, discount: float, a: np.ndarray) -> np.ndarray:
    """The chance that the customer taken out opens a table; ``left``: tables without it, ``a``: weight of a new one."""
    return a / (a + customers - 1 - discount * left)


def visit(customers: np.ndarray, tables: np.ndarray, discount: float, weight, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Take one customer out of each cell and seat it again: whether its table goes, and whether it opens one.

    ``weight``: from whether the table goes to the weight of a new one.
    """
    gone = rng.random(len(customers)) < alone(customers, tables, discount)
    return gone, rng.random(len(customers)) < opens(customers, tables - gone, discount, weight(gone))


def in_turn(visits: int, customers: int, tables: int, discount: float, weight, rng: np.random.Generator) -> tuple[int, float]:
    """Visit one cell so many times: its tables after that, and the sum of the tables expected at each visit.

    ``weight``: from whether a table goes, and by how many tables the cell has grown, to the weight of a new one.
    """
    start, kept, low, chances = tables, 0.0, 0, []
    for first in range(0, visits, AHEAD):
        m = min(AHEAD, visits - first)
        if not low <= tables - m <= tables + m < low + len(chances):
            low = max(tables - 2 * AHEAD, 0)
            t = np.arange(low, tables + 2 * AHEAD + 1)
            chances = alone(np.full(len(t), customers), np.clip(t, 1, customers), discount).tolist()
        for x, y in zip(rng.random(m).tolist(), rng.random(m).tolist()):
            gone = x < chances[tables - low]
            a, left = weight(gone, tables - start), tables - gone
            p = a / (a + customers - 1 - discount * left)
            kept += left + p
            tables = left + (y < p)
    return tables, kept


class Rounds:
    """The order of a sweep's visits to cells of these customers."""

    def __init__(self, customers: np.ndarray):
        self.order = np.argsort(-customers, kind="stable")
        ascending = np.sort(customers)
        live = len(customers) - np.searchsorted(ascending, np.arange(ascending[-SIDE] if len(customers) >= SIDE else 0), side="right")
        #: Cells of each round, the first in ``order``; rounds go on while there are ``SIDE`` cells with customers to come.
        self.live = live.tolist()
        #: Cells with more customers than rounds, and the visits that they still get.
        self.rest = [(i, n) for i, n in zip(self.order.tolist(), (customers[self.order] - len(live)).tolist()[: SIDE]) if n > 0]


class Pairs:
    """The cells of one owner, from the questions of all blocks."""

    def __init__(self, owner: int, rows: list[tuple[int, bytes]]):
        self.seed, self.blocks, self.sizes, columns = owner, [], [], []
        for block, packed in rows:
            new, du, dn, dw, n = _unpack(packed, bool, np.int64, np.int64, np.int64, np.int32)
            which = np.cumsum(new) - 1
            w = np.cumsum(dw)
            w -= (w[new] - dw[new])[which]
            self.blocks.append(block)
            self.sizes.append(len(n))
            columns.append((np.cumsum(du)[which], np.cumsum(dn)[which], w, n))
        u, total, w, n = map(np.concatenate, zip(*columns))
        self.contexts, first, u = np.unique(u, return_index=True, return_inverse=True)
        #: Customers of each context, with all owners.
        self.totals = total[first]
        key = u << WORD_BITS | w
        order = np.argsort(key)
        key = key[order]
        new = _runs(key)
        pair = np.cumsum(new) - 1
        self.question = np.empty(len(order), np.int64)  # each question's cell
        self.question[order] = pair
        self.count = np.bincount(pair, n[order]).astype(np.int64)
        key = key[new]
        self.context = key >> WORD_BITS
        self.words, self.word = np.unique(key & (1 << WORD_BITS) - 1, return_inverse=True)
        #: Cells whose tables can change.
        self.open = np.flatnonzero(self.count > 1)

    def summed(self, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each word and of each context, from those of the open cells; others have one table a customer."""
        t = np.minimum(self.count, 1)
        t[self.open] = tables
        return np.bincount(self.word, t, len(self.words)).astype(np.int64), np.bincount(self.context, t, len(self.contexts)).astype(np.int64)

    def tables(self, base: float) -> np.ndarray:
        """The averaged tables of the open cells, in ``UNITS``.

        The parent holds the tables of all contexts as customers, one table for each word.  Tables with other owners
        are taken to be as many for the customers there as here: those of a context, of a word, and of all.  How many
        customers a word has is known where it is a context here, too; a word that is none is rare, and taken to be here alone.
        """
        (d0, s0), (d, s), rng = PARENT, CONTEXT, np.random.default_rng(self.seed)
        cell, c = self.open, self.count[self.open]
        context, word = self.context[cell], self.word[cell]
        scale = (self.totals / np.maximum(np.bincount(self.context, self.count, len(self.contexts)), 1))[context]
        own = np.bincount(self.word, self.count, len(self.words))
        at = np.minimum(np.searchsorted(self.contexts, self.words), len(self.contexts) - 1)
        share = (np.where(self.contexts[at] == self.words, self.totals[at], own) / np.maximum(own, 1))[word]
        whole, unseen = float(self.totals.sum() / max(own.sum(), 1)), (s0 + d0 * (1 / base - 1)) * base
        up, held = self.summed(np.ones(len(cell), np.int64))
        first = (s + d * held[context] * scale) * (np.maximum(up[word] * share - d0, 0) + unseen) / (s0 + whole * up.sum())
        t, kept, rounds = seat(c, first, d, rng).astype(np.int64), np.zeros(len(cell)), Rounds(c)
        # What a round needs of its cells, in the order of visits.
        order, size = rounds.order, c[rounds.order]
        room, dish, scale, share = context[order], word[order], scale[order], share[order]
        t = t[order]
        for k in range(BURN + KEEP):
            back = np.empty_like(t)
            back[order] = t
            up, held = self.summed(back)
            total = int(up.sum())
            for n in rounds.live:
                u, w = room[:n], dish[:n]
                weight = lambda gone: (s + d * (held[u] * scale[:n] - gone)) * (np.maximum(up[w] * share[:n] - gone - d0, 0) + unseen) / (s0 + whole * total)  # noqa: B023, E731
                gone, new = visit(size[:n], t[:n], d, weight, rng)
                if k >= BURN:
                    left = t[:n] - gone
                    kept[:n] += (left + opens(size[:n], left, d, weight(gone))) / size[:n]
                moved = np.flatnonzero(gone != new)
                by = new[moved].astype(np.int64) - gone[moved]
                t[moved] += by
                np.add.at(up, w[moved], by)
                np.add.at(held, u[moved], by)
                total += int(by.sum())
            for i, (_, n) in enumerate(rounds.rest):
                u, w, f, g = int(room[i]), int(dish[i]), float(scale[i]), float(share[i])
                h, v, all_ = int(held[u]), int(up[w]), total
                one = lambda gone, more: (s + d * ((h + more) * f - gone)) * (max((v + more) * g - gone - d0, 0) + unseen) / (s0 + whole * (all_ + more))  # noqa: B023, E731
                now, tables = in_turn(n, int(size[i]), int(t[i]), d, one, rng)
                if k >= BURN:
                    kept[i] += tables / size[i]
                by = now - int(t[i])
                t[i], held[u], up[w], total = now, h + by, v + by, total + by
        back = np.empty_like(kept)
        back[order] = kept
        return np.rint(back * (UNITS / KEEP)).astype(np.int64)

    def answers(self, kept: np.ndarray, parent: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The averaged probability of each cell's word: ``parent`` by word, ``held`` tables by context."""
        d, s = CONTEXT
        t = np.minimum(self.count, 1).astype(np.float64)
        t[self.open] = kept / UNITS
        return (self.count - d * t + (s + d * held[self.context]) * parent[self.word]) / (s + self.totals[self.context])


def _by_owner(ids: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted ids by the owner of their sums, and those owners in that order."""
    owner = ids % owners
    order = np.argsort(owner, kind="stable")
    return order, owner[order]


def _sums(own: Pairs, kept: np.ndarray, owners: int) -> list[tuple]:
    """Rows for the owners of sums: words with their tables, contexts with theirs; both averaged, in ``UNITS``."""
    up, held = (UNITS * x for x in own.summed(np.zeros(len(own.open), np.int64)))
    np.add.at(up, own.word[own.open], kept)
    np.add.at(held, own.context[own.open], kept)
    parts: dict[int, list] = {}
    for k, (ids, x) in enumerate(((own.words, up), (own.contexts, held))):
        order, owner = _by_owner(ids, owners)
        for o, a, z in _cuts(owner):
            parts.setdefault(o, [np.empty(0, np.int64)] * 4)[2 * k : 2 * k + 2] = np.diff(ids[order[a:z]], prepend=0), x[order[a:z]]
    return [(own.seed, o, _pack(*x)) for o, x in parts.items()]


def _sample(owners: int, base: float):
    """An owner's questions to its sums, and what it keeps for itself (owner -1)."""

    def run(table: pa.Table) -> pa.Table:
        own = Pairs(table["owner"][0].as_py(), _messages(table))
        kept = own.tables(base)
        return _table([(own.seed, -1, _pack(kept)), *_sums(own, kept, owners)], MESSAGE)

    return run


class Sums:
    """The words of one owner in the parent, and the contexts whose tables it adds up, from the rows of all owners of pairs."""

    def __init__(self, owner: int, rows: list[tuple[int, bytes]]):
        self.seed, self.sources, parts = owner, [], []
        for source, packed in rows:
            dw, up, du, held = _unpack(packed, *[np.int64] * 4)
            self.sources.append((source, len(dw), len(du)))
            parts.append((np.cumsum(dw), up, np.cumsum(du), held))
        w, up, u, held = map(np.concatenate, zip(*parts))
        _, self.word = np.unique(w, return_inverse=True)
        _, self.context = np.unique(u, return_inverse=True)
        #: Customers of each word in the parent, rounded: averaged tables of contexts.
        self.customers = np.rint(np.bincount(self.word, up) / UNITS).astype(np.int64)
        self.held = np.bincount(self.context, held) / UNITS

    def tables(self, scale: int, base: float) -> np.ndarray:
        """The averaged tables of each word in the parent; all owners' tables are taken to be ``scale`` times this one's."""
        (d, s), rng = PARENT, np.random.default_rng(self.seed)
        cell = np.flatnonzero(self.customers > 1)
        c, t = self.customers[cell], np.minimum(self.customers, 1).astype(np.float64)
        single = int(t.sum()) - len(cell)
        rounds = Rounds(c)
        size = c[rounds.order]
        own = seat(size, np.full(len(c), (s + d * scale * (single + len(cell))) * base), d, rng).astype(np.int64)
        kept = np.zeros(len(cell))
        for k in range(BURN + KEEP):
            total = single + int(own.sum())
            for n in rounds.live:
                weight = lambda gone: (s + d * (scale * total - gone)) * base  # noqa: B023, E731
                gone, new = visit(size[:n], own[:n], d, weight, rng)
                if k >= BURN:
                    left = own[:n] - gone
                    kept[:n] += (left + opens(size[:n], left, d, weight(gone))) / size[:n]
                by = new.astype(np.int64) - gone
                own[:n] += by
                total += int(by.sum())
            for i, (_, n) in enumerate(rounds.rest):
                all_ = total
                one = lambda gone, more: (s + d * (scale * (all_ + more) - gone)) * base  # noqa: B023, E731
                now, tables = in_turn(n, int(size[i]), int(own[i]), d, one, rng)
                if k >= BURN:
                    kept[i] += tables / size[i]
                own[i], total = now, all_ + now - int(own[i])
        t[cell[rounds.order]] = kept / KEEP
        return t


def _totals(scale: int, base: float):
    def run(table: pa.Table) -> pa.Table:
        own = Sums(table["owner"][0].as_py(), _messages(table))
        return _table([(int(own.customers.sum()), float(own.tables(scale, base).sum()))], "customers long, tables double")

    return run


def _tell(scale: int, base: float, customers: int, tables: float):
    """The sums of an owner to rows for each owner of pairs: its words' probabilities in the parent, its contexts' tables."""

    def run(table: pa.Table) -> pa.Table:
        own, (d, s) = Sums(table["owner"][0].as_py(), _messages(table)), PARENT
        p = (own.customers - d * own.tables(scale, base) + (s + d * tables) * base) / (s + customers)
        rows, i, j = [], 0, 0
        for source, n, m in own.sources:
            rows.append((source, own.seed, _pack(p[own.word[i : i + n]].astype(np.float32), own.held[own.context[j : j + m]].astype(np.float32))))
            i, j = i + n, j + m
        return _table(rows, MESSAGE)

    return run


def _shortened(p: np.ndarray) -> np.ndarray:
    """Probabilities with 16 bits after the leading one, which leaves a byte of each empty."""
    return ((p.astype(np.float32).view(np.uint32) + np.uint32(0x40)) & np.uint32(0xFFFFFF80)).view(np.float32)


def _answer(owners: int):
    def run(questions: pa.Table, told: pa.Table) -> pa.Table:
        if not questions.num_rows:
            return _table([], MESSAGE)
        own = Pairs(questions["owner"][0].as_py(), _messages(questions))
        parent, held = np.empty(len(own.words)), np.empty(len(own.contexts))
        kept, by_word, by_context = None, _by_owner(own.words, owners), _by_owner(own.contexts, owners)
        for o, data in zip(told["owner"].to_pylist(), told["data"].to_pylist()):
            if o < 0:
                (kept,) = _unpack(data, np.int64)
                continue
            p, h = _unpack(data, np.float32, np.float32)
            for out, (order, owner), x in ((parent, by_word, p), (held, by_context, h)):
                a, z = np.searchsorted(owner, (o, o + 1))
                out[order[a:z]] = x
        found, at, rows = _shortened(own.answers(kept, parent, held)), 0, []
        for block, size in zip(own.blocks, own.sizes):
            rows.append((block, own.seed, _pack(found[own.question[at : at + size]])))
            at += size
        return _table(rows, MESSAGE)

    return run


# --- scores --------------------------------------------------------------------------------

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(trained: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for packed in texts["data"].to_pylist():
            null, doc_ids, sizes, n_known, base, steps = _unpack(packed, bool, np.int64, np.int64, np.int64, np.float64, np.int32)
            told = sorted(zip(answers["owner"].to_pylist(), answers["data"].to_pylist()))
            log_p = np.log10(np.concatenate([_unpack(x, np.float32)[0] for _, x in told]).astype(np.float64))
            score = np.add.reduceat(log_p[np.cumsum(steps, dtype=np.int64)], np.cumsum(sizes) - sizes)
            ids = [None if gone else d for gone, d in zip(null.tolist(), doc_ids.tolist())]
            rows += zip(ids, map(held_out, ids), sizes.tolist(), n_known.tolist(), [trained] * len(ids), base.tolist(), score.tolist())
        return _table(rows, SCORES)

    return run


def score(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and score all of them, in the columns of ``SCORES``."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = size // OWNER_BYTES + 1
    by_block = lambda df: df.where("owner < 0").groupBy("source")
    by_owner = lambda df: df.where("owner >= 0").groupBy("owner")
    words = stage(rows.mapInArrow(_count(owners), MESSAGE), "lm-words")
    vocabulary = stage(by_owner(words).applyInArrow(_vocabulary(owners), VOCABULARY), "lm-vocabulary")
    distinct, trained = (x or 0 for x in vocabulary.agg(F.sum("distinct"), F.sum("trained")).first())
    told = vocabulary.where("source >= 0").select("source", "owner", "data")
    pairs = stage(by_block(words).cogroup(told.groupBy("source")).applyInArrow(_pair_up(owners, trained, distinct), MESSAGE), "lm-pairs")
    drop(docs.sparkSession, words, vocabulary)
    base = 1 / (distinct + 1)
    sums = stage(by_owner(pairs).applyInArrow(_sample(owners, base), MESSAGE), "lm-sums")
    customers, tables = by_owner(sums).applyInArrow(_totals(owners, base), "customers long, tables double").agg(F.sum("customers"), F.sum("tables")).first()
    told = by_owner(sums).applyInArrow(_tell(owners, base, customers or 0, tables or 0.0), MESSAGE).unionByName(sums.where("owner < 0"))
    answers = stage(by_owner(pairs).cogroup(told.groupBy("source")).applyInArrow(_answer(owners), MESSAGE), "lm-answers")
    return by_block(pairs).cogroup(answers.groupBy("source")).applyInArrow(_score(trained), SCORES)


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, n_tokens, perplexity, base_perplexity) over training and held-out texts."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
