import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    path, pattern = bpe.defaults()
    return bpe.codec(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab the ing 's't\n\r\t  \x0b\x1c\x85\xa0 éß東👍0१<|endoftext|>", max_size=80))
def test_ids_are_those_of_the_other_library(pair, text):
    own, other = pair
    ids = own.encode([text])[0]
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="ab the ing's\n\t éß東👍👩‍👩‍👧0१", max_size=60), max_size=6))
def test_offsets_are_the_librarys(pair, texts):
    own = pair[0]
    cuts, ids, starts, ends = own.encode_with_offsets(texts)
    for k, e in enumerate(own.tokenizer.encode_batch(texts, add_special_tokens=False)):
        part = slice(cuts[k], cuts[k + 1])
        assert ids[part].tolist() == e.ids
        assert list(zip(starts[part].tolist(), ends[part].tolist())) == e.offsets


def test_decoding_of_odd_rows(spark, documents):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(rows).collect()}
    assert got == {1: "", 2: "", 3: bpe.token_bytes(bpe.defaults()[0])[64].decode()}
    split = bpe.codec(*bpe.defaults()).encode(["\U0001f44d\U0001f3fd"])[0]
    assert len(split) > 2  # characters are split between ids
    with pytest.raises(Exception, match="(?i)utf"):
        bpe.decode(spark.createDataFrame([(1, split[:1])], rows.schema)).collect()
    with pytest.raises(Exception, match="vocabulary|bounds"):
        bpe.decode(spark.createDataFrame([(1, [10_000_000])], rows.schema)).collect()


def test_queries_and_edge_cases(spark, documents, pair):
    texts = [None, "", "héllo wörld 東京 👍👍", "x" * 50000 + " y" * 50000, "a", "a"]
    docs = documents(list(enumerate(texts))).withColumnRenamed("lang", "ids")
    encoded = bpe.encode(docs)
    rows = {r.doc_id: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == pair[1].encode_ordinary(t or "")
        assert all((t or "")[a:z] for a, z in zip(rows[i].starts, rows[i].ends))
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for r in bpe.round_trip(docs).collect():
        text = texts[r.doc_id] or ""
        assert r.n_tokens == len(rows[r.doc_id].ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, rows[r.doc_id].ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(documents([])).count() == 0


def test_query_runs_encode_and_decode(spark, documents, monkeypatch):
    """The digests are those of the operator's own outputs, offsets included."""
    seen = []
    encode, decode = bpe.encode, bpe.decode
    monkeypatch.setattr(bpe, "encode", lambda *a: seen.append("encode") or encode(*a))
    monkeypatch.setattr(bpe, "decode", lambda e, *a: seen.append(e.columns) or decode(e, *a))
    docs = documents([(1, "h\u00e9llo \U0001f44d"), (1, "h\u00e9llo \U0001f44d"), (None, None)])
    rows = bpe.round_trip(docs).collect()
    assert seen == ["encode", ["doc_id", "ids", "starts", "ends"]]
    expect = hashlib.sha256("h\u00e9llo \U0001f44d".encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.decoded_sha256 == expect) for r in rows) == [(0, False), (1, True), (1, True)]


def test_decoding_in_slices(spark, documents, monkeypatch):
    """Slices hold every row once and in order, and a list beyond the bound is alone."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "DECODED", 5)
    lists = [[1] * n for n in (2, 3, 0, 9, 0, 5, 1, 4, 6)]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([*lists, None], pa.list_(pa.int32()))})
    sizes = [[len(x or []) for x in part["ids"].to_pylist()] for part in bpe._slices(batch)]
    assert [n for part in sizes for n in part] == [*map(len, lists), 0]
    assert all(sum(part) <= 5 or len(part) == 1 for part in sizes)
    assert list(bpe._slices(batch.slice(0, 0))) == []
