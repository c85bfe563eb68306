import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palimpsest.llm.decontamination import contamination, hit_spans, occurrences, uid, windows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain(docs, items, length=10):
    """(doc_id, n_words, n_hit, items) of each document, by comparing every window with every place."""
    own = {}
    for item_id, text in items:
        ws = plain_words(text)
        for i in range(max(len(ws) - length, 0) + 1 if ws else 0):
            own.setdefault(tuple(ws[i : i + length]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        ws, hit, held = plain_words(text), set(), set()
        for m in {len(w) for w in own}:
            for i in range(len(ws) - m + 1):
                w = tuple(ws[i : i + m])
                if w in own:
                    hit.update(range(i, i + m))
                    held |= own[w]
        out.append((doc_id, len(ws), len(hit), sorted(held)))
    return sorted(out, key=str)


def rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, "window", "shingle", 0) for i, t in docs], "doc_id long, text string, key string, source string, pos long")
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(contamination(docs, items))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[2] for r in got) and not all(r[2] for r in got)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "w5 w6 w7"), (3, "Only, two"), (4, "solo"), (5, None), (6, ""), (7, "!?"), (None, "w30 w31 w32 w33 w34 w35"), (1, LONG), (8, "x x x x x x x x x x x x"), (9, "ÄÖ é ÄÖ é ÄÖ é ÄÖ é ÄÖ é")]
DOCS = [
    (1, "a " + LONG + " b"), (2, LONG.upper().replace(" ", ", ")), (3, "w5 w6 w8 w7 only two w5 w6 w7 w8"), (4, None), (5, ""), (6, "nothing here"), (7, "x " * 30), (None, "solo w1 solo"),
    (8, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (10, "äö é ÄÖ é ÄÖ é ÄÖ é ÄÖ é ÄÖ é"), (11, ("y " * 5000 + LONG + " ") * 20),
]


def test_edge_cases(spark):
    assert rows(contamination(*tables(spark, DOCS, ITEMS))) == plain(DOCS, ITEMS)


@pytest.mark.parametrize(("length", "shingle"), [(4, 2), (3, 5), (7, 1)])
def test_other_lengths(spark, length, shingle):
    assert rows(contamination(*tables(spark, DOCS, ITEMS), length, shingle)) == plain(DOCS, ITEMS, length)


def test_empty_tables(spark):
    none = tables(spark, [], [])
    some = tables(spark, DOCS, ITEMS)
    assert contamination(none[0], some[1]).count() == 0
    assert rows(contamination(some[0], none[1])) == plain(DOCS, [])
    assert rows(contamination(*tables(spark, DOCS, [(1, ""), (2, None)]))) == plain(DOCS, [])


def test_sort_merge_gives_the_same(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert rows(contamination(*tables(spark, DOCS, ITEMS))) == plain(DOCS, ITEMS)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab ", max_size=40), min_size=1, max_size=6), st.lists(st.text("ab ", max_size=12), min_size=1, max_size=5))
def test_few_words_that_repeat(spark, docs, items):
    docs, items = list(enumerate(docs)), list(enumerate(items))
    assert rows(contamination(*tables(spark, docs, items), 4, 2)) == plain(docs, items, 4)


def test_places_and_spans(spark):
    docs, items = tables(spark, [(1, "a " + LONG)], [(1, LONG)])
    found = windows(items)
    places = occurrences(docs.select(uid().alias("uid"), words(docs.text).alias("words")), found)
    assert sorted((r.start, r.m) for r in places.collect()) == [(i + 1, 10) for i in range(31)]
    assert sorted((r.start, r.n_new) for r in hit_spans(places).collect()) == [(1, 10), *((i, 1) for i in range(2, 32))]
