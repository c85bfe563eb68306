"""Logs of state, JSON at the edges, searches and clusters at every threshold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import payload
from palimpsest.operators import hierarchy, report, search, state
from palimpsest.sources.keyed_log import KeyedLog


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    log = KeyedLog(spark, f"file://{tmp_path}/docs", "id STRING, release_batch STRING, text_processed BOOLEAN, pdf_processed BOOLEAN", ["id"], 4)
    log.write(spark.createDataFrame([("a", "1", True, False), ("b", "1", False, False), ("c", "1", False, True)], "id string, release_batch string, text_processed boolean, pdf_processed boolean"), 0)
    new = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "2"), ("d", "2")], "id string, release_batch string")
    read = lambda: sorted((r.id, r.release_batch, r.text_processed) for r in log.latest().collect())
    for _ in range(2):
        state.store_documents(log, new, 1)
        assert read() == [("a", "1", True), ("b", "2", False), ("c", "1", False), ("d", "2", False)]
    assert sorted(r.id for r in log.rows().where("batch = 1").collect()) == ["b", "d"]


def test_provenance(spark, tmp_path):
    log = KeyedLog(spark, f"file://{tmp_path}/prov", "dataset BIGINT, entry STRING", ["dataset"], 4)
    rows = [(8, '{"url":"u","n":3,"downloaded_at":"old"}'), (9, None), (10, "not json")]
    state.store_provenance(log, spark.createDataFrame(rows, "dataset int, entry string"), 0, F.lit("t0"))
    state.store_provenance(log, spark.createDataFrame([(9, '{"ü":null}')], "dataset int, entry string"), 1)
    got = {r.dataset: (r.entry, r.downloaded_at) for r in state.provenance_of(log).collect()}
    assert got[8] == ({"url": "u", "n": "3", "downloaded_at": "t0"}, "t0") and got[10][1] == "t0"
    assert got[9][0]["ü"] is None and got[9][1].startswith("20")


def test_backfill_of_texts(spark):
    rows = [("1", "src0", "", True, None), ("2", "src0", None, True, None), ("3", "src0", None, True, "ocr"), ("4", "other", None, True, None), ("5", "src0", "has", True, None), ("6", "src0", "", False, None), ("7", "src0", "", True, None)]
    docs = spark.createDataFrame(rows, "id string, release_batch string, extracted_text string, text_processed boolean, text_source string")
    texts = lambda *r: spark.createDataFrame(r, "id string, extracted_text string")
    got = state.backfill_texts(docs, texts(("1", "shard"), ("7", ""), ("4", "x"), ("1", "shard")), texts(("1", "layer"), ("2", "layer"), ("3", "y"), ("6", "z")), ["src0"])
    assert {r.id: (r.extracted_text, r.text_source) for r in got.collect()} == {
        "1": ("shard", "backfill"), "2": ("layer", "text_layer"), "3": (None, "ocr"), "4": (None, None), "5": ("has", None), "6": ("", None), "7": ("", None),
    }


def test_payload_round_trip(spark):
    texts = ['{"query":"a \\"ü\\"","batch":null,"more":{"k":[1,2]},"n":5}', "{}", None, "no json", '{"doc_id":7}']
    jobs = spark.createDataFrame(list(enumerate(texts)), "job_id int, payload string")
    rows = payload.read_payload(jobs)
    got = {r.job_id: r for r in rows.collect()}
    assert got[0].query == 'a "ü"' and got[0].batch is None and got[0].rest == {"more": '{"k":[1,2]}', "n": "5"}
    assert got[1].rest is None and got[2].query is None and got[4].doc_id == "7"
    again = {r.job_id: json.loads(r.p) for r in rows.select("job_id", payload.write_payload(rows).alias("p")).collect()}
    assert again[0] == {"query": 'a "ü"', "more": '{"k":[1,2]}', "n": "5"} and again[1] == again[2] == {}


def test_segments_and_page_classes(spark):
    rows = spark.createDataFrame([("g", [("ü", None, "merge", "high", 3, 4)]), ("h", []), ("i", None)], f"group_id string, s {payload.SEGMENTS}")
    again = rows.withColumn("again", payload.segments_of(payload.segments_json(F.col("s")))).collect()
    assert all(r.s == r.again for r in again)
    pages = spark.createDataFrame([("a", 10, "text"), ("a", 2, "photo"), ("b", 1, None)], "id string, page int, class string")
    docs = payload.page_classes_json(pages)
    assert {r.id: r.classes for r in docs.collect()}["a"] == '{"2":"photo","10":"text"}'
    assert sorted((r.id, r.page) for r in payload.page_classes(docs).collect() if r["class"]) == [("a", 2), ("a", 10)]


def test_search_equals_the_plain_filter(spark, tmp_path):
    rng = random.Random(8)
    rows = [(str(i), f"b{i % 3}", f"2024-01-{1 + i % 28:02}", None if i % 17 == 0 else "".join(rng.choices("abÄ. ", k=rng.randint(0, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "id string, release_batch string, sent string, extracted_text string").withColumn("sent", F.col("sent").cast("date")).cache()
    emails = spark.createDataFrame([(i, "Ann Bo" if i % 2 else "Cy") for i in range(100)], "doc_id int, all_participants string")
    index = search.TextIndex(spark, f"file://{tmp_path}/index", 4)
    index.add(docs.where("CAST(id AS INT) < 70"), 0)
    index.add(docs.where("CAST(id AS INT) >= 70"), 1)
    words = ["ab", "aba", "Aäb", "b. a", "", "zzz", "ababa", "%_a"]
    for word in words:
        for batch, dates, who in ((None, None, None), ("b1", None, None), (None, ("2024-01-05", "2024-01-20"), "ann"), ("b2", ("2024-01-01", "2024-01-28"), "ANN")):
            args = dict(batch=batch, dates=dates, person=who, emails=emails)
            with_index = {r.id for r in search.search(docs, word, index=index, **args).collect()}
            plain = {i for i, b, s, t in rows if t is not None and word.lower() in t.lower() and (batch is None or b == batch) and (dates is None or dates[0] <= s <= dates[1]) and (who is None or (int(i) < 100 and int(i) % 2))}
            assert with_index == plain
    assert {r.id for r in search.search(docs, doc_id="5", index=index).collect()} == {"5"}
    wanted = spark.createDataFrame([(k, w) for k, w in enumerate(words) if len(w) > 2], "query_id int, word string")
    got = {(r.query_id, r.id) for r in search.searches(docs, index, wanted).collect()}
    assert got == {(k, i) for k, w in enumerate(words) if len(w) > 2 for i, _, _, t in rows if t and w.lower() in t.lower()}


def plain_components(nodes, edges):
    top = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    return top


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_of_the_forest_are_components_of_the_pairs(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"{a:02}", f"{b:02}"): rng.choice([0.5, 0.6, 0.7, 0.7, 0.8, 0.9]) for a, b in {tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}}
    forest = hierarchy.spanning_forest(spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "doc_id_a string, doc_id_b string, similarity double"))
    assert forest.count() == 40 - len(set(plain_components([f"{i:02}" for i in range(40)], pairs).values()))
    for t in (0.5, 0.65, 0.7, 0.85, 0.95):
        kept = [p for p, s in pairs.items() if s >= t]
        nodes = {x for p in kept for x in p}
        assert {r.doc_id: r.group_id for r in hierarchy.cut(forest, t).collect()} == plain_components(nodes, kept)


def test_split_by_forest(spark):
    chain = [("a", "b", 0.95), ("b", "c", 0.72), ("c", "d", 0.9), ("d", "e", 0.91), ("x", "y", 0.7)]
    forest = spark.createDataFrame(chain, "doc_id_a string, doc_id_b string, similarity double")
    members = spark.createDataFrame([(x, "g") for x in "abcdef"] + [("x", "h"), ("y", "h")], "doc_id string, group_id string")
    split = lambda n: {r.doc_id: r.group_id for r in hierarchy.split_by_forest(members, forest, n).collect()}
    assert split(6) == dict.fromkeys("abcdef", "g") | {"x": "h", "y": "h"}
    assert split(4) == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "x": "h", "y": "h"}  # f has no neighbour; a to e are cut once more
    assert split(2) == {"a": "a", "b": "a", "x": "h", "y": "h"}  # c, d, e come apart at 0.95, the last threshold


def test_metadata_page_of_unknown_documents(spark):
    seg = "array<struct<confidence:string>>"
    results = spark.createDataFrame([("g", 2, ["1", "2"], [("high",), ("questionable",)]), ("h", 0, ["3"], [])], f"group_id string, recovered_count bigint, source_doc_ids array<string>, recovered_segments {seg}")
    docs = spark.createDataFrame([("1", "one.pdf", None, "VOL00008")], "id string, original_filename string, pdf_url string, release_batch string")
    labels = spark.createDataFrame([(8, "eighth")], "dataset bigint, label string")
    (row,) = report.metadata_pages(results, docs, labels).collect()
    assert (row.base_id, row.questionable, row.method, row.label) == ("1", 1, "cross-document merge", "eighth")
    assert row.page.split("\n") == ["recovered: 2", "method: cross-document merge", "questionable: 1", "provenance: eighth", "document: one.pdf  id 1", "source:", "[1] ?  id 2"]
