"""Numbers of greedy longest-match word pieces, in time linear in the text.

The vocabulary is a trie over bytes.  Each node has a failure link to the node
that stands for what is left once the longest pieces are popped off the front of
its string, and the number of pieces popped on the way.  A word is read byte by
byte: where a node has no edge for the next byte, its popped pieces are counted
and reading goes on at its failure link.  No piece is ever built.

A word is a maximal run of characters other than blank, tab, newline, vertical
tab, form feed and return; it is matched with one blank before it, so that the
vocabulary's pieces for the start of a word apply.  Every single byte has to be
in the vocabulary, so that each word can be matched.

Defined cases: null and empty texts have no words; repeated rows are counted
each for itself; a null doc_id is passed on; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.bpe import defaults, read_ranks

#: Words whose counts a worker remembers.
REMEMBERED = 500_000


class PieceCounter:
    """Counts the greedy longest-match pieces of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes], remembered: int = REMEMBERED):
        self.edges: dict[int, int] = {}  # node * 256 + byte: next node
        ends, parents = [False], [(0, 0)]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.edges:
                    self.edges[key] = len(ends)
                    ends.append(False)
                    parents.append((node, byte))
                node = self.edges[key]
            ends[node] = bool(piece)
        if any(b not in self.edges or not ends[self.edges[b]] for b in range(256)):
            raise ValueError("every single byte has to be in the vocabulary")
        self.fail, self.popped = [0] * len(ends), [0] * len(ends)
        # A node's parent has a smaller number of bytes, so shorter strings first.
        depth = [0] * len(ends)
        for node in range(1, len(ends)):
            depth[node] = depth[parents[node][0]] + 1
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            parent, byte = parents[node]
            at, count = self.fail[parent], self.popped[parent]
            while (at << 8 | byte) not in self.edges:
                count += self.popped[at]
                at = self.fail[at]
            self.fail[node], self.popped[node] = self.edges[at << 8 | byte], count
        self.known: dict[bytes, int] = {}
        self.remembered = remembered

    def count(self, word: bytes) -> int:
        """Pieces of one byte string."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for byte in word:
            key = node << 8 | byte
            while key not in edges:
                total += popped[node]
                node = fail[node]
                key = node << 8 | byte
            node = edges[key]
        while node:
            total += popped[node]
            node = fail[node]
        return total

    def words(self, text: bytes) -> tuple[int, int]:
        """Words of a text, and pieces of all of them."""
        words, known = text.split(), self.known
        try:
            return len(words), sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self.remembered:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.count(b" " + w)
            return len(words), sum(map(known.__getitem__, words))


_workers: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens for each row, by the pieces in the file of ranks at ``path``."""
    where = path or defaults()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if where not in _workers:
            _workers[where] = PieceCounter(read_ranks(where))
        counter = _workers[where]
        for b in batches:
            found = [counter.words(t.as_py() or b"") for t in b["text"]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    rows = docs.select("doc_id", docs["text"].cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
