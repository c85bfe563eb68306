import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    t.encode_special_tokens = True
    return t


WORDS = packing.WordIds(packing.vocabulary_path(), remembered=50)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aBéÉßÿ×÷ÞſKσΣς'’.,!-12 \t\x0b\x0c\n\x85\xa0é<|endoftext|>", max_size=40))
def test_ids_are_the_librarys(tokenizer, text):
    got = np.frombuffer(WORDS.ids(text.encode()), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_curve_steps_are_of_length_one():
    side = 1 << 3
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3), axis=-1).reshape(-1, 3)
    key = packing.hilbert_key(grid, bits=3)
    assert sorted(key) == list(range(side**3))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def check(tokenizer, docs, pieces, length=2048):
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in docs}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert zlib.crc32(part.tobytes()) == p.ids_crc32
        assert p.doc_tokens == len(ids[p.doc_id])
    for k, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert sum(p.length for p in own) == len(ids[k])
    assert set(by_doc) == set(ids)
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert sum(p.length for p in own) <= length
    return by_seq


def test_pieces(spark, documents, tokenizer):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "béta,", "12.5", "x"]) for _ in range(rng.choice([0, 1, 30, 900, 9000])))) for i in range(60)]
    docs += [(900, None), (901, "word " * 60000)]
    by_seq = check(tokenizer, docs, packing.pack(documents(docs).withColumnRenamed("lang", "key")).collect())
    filled = sum(p.length for own in by_seq.values() for p in own)
    assert filled / (2048 * len(by_seq)) > 0.95


def test_repeated_and_null_ids(spark, documents):
    docs = documents([(1, "a b"), (1, "a b"), (None, "c"), (2, None)])
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in rows) == [(False, 1, 3), (False, 1, 3), (False, 2, 1), (True, 0, 2)]
    assert packing.pack(documents([])).count() == 0


def test_sequences_hold_their_ids_and_are_full(spark, documents, tokenizer):
    """All ids come back from the pieces and from the sequences, and only the last sequence of a task is not full."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "b\u00e9ta,", "12.5", "x"]) for _ in range(rng.choice([0, 1, 30, 100, 900])))) for i in range(80)]
    made = packing.pack(documents(docs), length=100)
    pieces = made.collect()
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in docs}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length]
    by_seq = check(tokenizer, docs, pieces, length=100)
    got = {r.sequence_id: r for r in packing.sequences(made).collect()}
    assert set(got) == set(by_seq)
    for k, own in by_seq.items():
        assert np.frombuffer(got[k].ids, "<u4").tolist() == [x for p in own for x in ids[p.doc_id][p.start : p.start + p.length]]
    last = {}
    for k in by_seq:
        last[k >> 32] = max(last.get(k >> 32, 0), k)
    assert all(got[k].n_ids == 100 for k in got if k not in last.values())
    assert len(got) > 100


def test_long_words_take_linear_time():
    """Every length of letters, signs and mixtures with a byte last that plain words do not hold."""
    began = time.perf_counter()
    for run in (b"a", b"!", "é".encode(), b"a!", b"1", b"ab1-"):
        for foreign in (b"'", "’".encode(), "Ж".encode(), "×".encode()):
            for n in (*range(1, 400), 1000, 10_000):
                assert not packing._PLAIN.fullmatch(run * n + foreign)
                assert packing._PLAIN.fullmatch(run * n)
    assert time.perf_counter() - began < 20
    assert len(WORDS.ids(b"internationalisation" * 500 + b"'s")) > 0
