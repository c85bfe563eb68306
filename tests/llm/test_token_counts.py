import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.bpe import defaults, read_ranks
from palimpsest.llm.token_counts import PieceCounter, token_counts


def plain(word, vocabulary, longest):
    n = i = 0
    while i < len(word):
        i += next(k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in vocabulary)
        n += 1
    return n


BYTES = [bytes([b]) for b in range(256)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.lists(st.sampled_from("abc"), max_size=30))
def test_small_vocabularies(pieces, letters):
    vocabulary = set(BYTES) | set(pieces)
    word = "".join(letters).encode()
    assert PieceCounter(vocabulary).count(word) == plain(word, vocabulary, 6)


def test_needs_every_byte():
    with pytest.raises(ValueError, match="every single byte"):
        PieceCounter([b"a", b"ab"])


def test_whole_table(spark):
    vocabulary = read_ranks(defaults()[0])
    longest = max(map(len, vocabulary))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(docs).collect()}
    memo = {}
    for r in docs.collect():
        words = r.text.encode().split()
        for w in words:
            if w not in memo:
                memo[w] = plain(b" " + w, vocabulary, longest)
        assert got[r.doc_id] == (len(words), sum(memo[w] for w in words))


def test_edge_cases(spark, documents):
    docs = documents([(1, None), (2, " \n"), (None, "the the"), (3, "x" * 200000), (3, "x" * 200000)]).withColumnRenamed("lang", "n_tokens")
    rows = sorted(((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts(docs).collect()))
    assert rows[:3] == [(0, 2, 2), (1, 0, 0), (2, 0, 0)]
    assert rows[3] == rows[4] and rows[3][1] == 1
    assert token_counts(documents([])).count() == 0
