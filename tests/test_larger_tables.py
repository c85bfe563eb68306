"""What only tables larger than the generated ones show."""

import hashlib
import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from palimpsest import staging
from palimpsest.config import MARKERS, Settings
from palimpsest.functions import minhash
from palimpsest.operators import capped, grouping, merge, search
from palimpsest.plans import queries


def test_ordered_lookup_of_an_id_that_only_large_tables_have(spark, tmp_path):
    rows = [(k, "src", 1, f"text {k}") for k in (3, 5, 9, 100000)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expect = duckdb.sql(queries.SQL["ordered_lookup"].replace("JOIN documents", f"JOIN '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [(r.pos, r.id) for r in queries.QUERIES["ordered_lookup"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expect) and (2, "100000") in got


def changed(rng, items, alphabet, times):
    out = list(items)
    for _ in range(times):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(5)] = rng.choices(alphabet, k=rng.randrange(6))
    return out


@pytest.mark.parametrize("kinds", [2, 4, 20, 60])
@pytest.mark.parametrize("step", [3, 1 << 20])
def test_replaced_stretches_are_those_of_difflib(monkeypatch, kinds, step):
    rng, alphabet, whole = random.Random(kinds), [chr(97 + k) for k in range(kinds)], merge._diagonals
    monkeypatch.setattr(merge, "_diagonals", lambda a, b: whole(a, b, step))
    for n in [0, 1, 5, 40, 199, 200, 260] * 6:
        a = rng.choices(alphabet, k=n)
        b = changed(rng, a, alphabet, rng.randrange(9))
        if rng.random() < 0.3:
            b = b[n // 3 :] + b[: n // 3]
        for x, y in ((a, b), ("".join(a), "".join(b))):
            expect = [tuple(op[1:]) for op in SequenceMatcher(None, x, y).get_opcodes() if op[0] == "replace"]
            assert merge._replaced(x, y) == expect


def test_alignment_leaves_out_only_what_would_not_be_confirmed():
    rng, words = random.Random(3), [f"word{chr(97 + k)}{chr(97 + k % 7)}" for k in range(24)]
    confirmed = 0
    for _ in range(150):
        base = rng.choices(words, k=40)
        donor = changed(rng, base, words, 3)
        masked = " ".join("[REDACTED]" if rng.random() < 0.1 else w for w in base).replace(" worda", "\n# **worda")
        text, other = masked, merge.Donor("d", " ".join(donor).replace(" wordb", "\n- wordb"))
        marks = merge.positions(text, MARKERS)
        wanted = merge.confirmable(text, marks, other, MARKERS)
        for start, (candidate, at) in merge.aligned(text, other.text, marks, MARKERS).items():
            if merge.confirmed(candidate, other.text, at, text, start, start + len("[REDACTED]"), MARKERS):
                confirmed += 1
                assert start in wanted
    assert confirmed > 20


def test_donors_are_aligned_only_where_that_can_fill_something(monkeypatch):
    calls, plain = [], merge.aligned
    monkeypatch.setattr(merge, "aligned", lambda *args: calls.append(args) or plain(*args))
    lead, tail = "the committee met at noon and heard", "about the budget of the coming year"
    base = ("b", f"{lead} [REDACTED] {tail} before all went home")
    others = [(f"d{k}", f"an unrelated report number {k} on roads and bridges") for k in range(20)]
    merge.merge_texts([base, *others])
    assert not calls
    # A word too short to be filled in: its donor is aligned in the first pass, and not again as long as the text is the same.
    twin = ("t", f"{lead} of {tail} before all went home [REDACTED]")
    second = ("u", "what stands in front of it was Alexandra Petrova who spoke at length of rivers [REDACTED]")
    base = ("b", f"{base[1]}. what stands in front of it was [REDACTED] who spoke at length of rivers and [REDACTED]")
    got = merge.merge_texts([base, twin, second])
    assert got.recovered == 1 and len([c for c in calls if c[1] == twin[1]]) == 1


def test_fingerprints_hold_few_texts_of_a_batch_at_once():
    a, b = (np.array(x) for x in zip(*minhash.permutations(8)))
    texts = [" ".join(f"w{k}x{i}" for i in range(k % 12)) for k in range(1000)]
    batch = pa.RecordBatch.from_pydict({"id": [str(k) for k in range(1000)], "clean": texts})
    got = list(minhash.signed(iter([batch]), 8, a, b))
    assert len(got) > 1 and max(x.num_rows for x in got) <= minhash.AT_ONCE
    expect = {str(k): s for k, t in enumerate(texts) if (s := minhash.signature(t.split(), 8, a, b))}
    assert {r["id"]: (r["sig"], r["shingle_count"]) for x in got for r in x.to_pylist()} == expect


def test_fingerprints_do_not_travel_by_group(spark, monkeypatch):
    plans, write = [], grouping.stage

    def kept(df, name):
        if "sig" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(grouping, "stage", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = spark.createDataFrame([(str(k), "g") for k in range(6)] + [("8", "h")], "doc_id string, group_id string")
        prints = spark.createDataFrame([(str(k), [k // 3 * 1000 + i for i in range(128)]) for k in range(5)], "id string, sig array<long>")
        got = {(r.doc_id, r.group_id) for r in grouping.split_groups(members, prints, Settings(split_above=2)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {("0", "0"), ("1", "0"), ("2", "0"), ("3", "3"), ("4", "3"), ("8", "h")}
    assert plans and not any("hashpartitioning(group_id" in p for p in plans)


def test_many_digests_and_signatures_at_once():
    """MD5 over many shingles at once is hashlib's, and a text's signature does not depend on those beside it (F14)."""
    text = ("añ😀 lorem " * 200).encode()
    starts = np.arange(0, 600)
    ends = starts + np.arange(600) * 7 % 260
    got = minhash.md5_heads(text, starts, ends)
    assert got.tolist() == [int(hashlib.md5(text[i:j]).hexdigest()[:8], 16) for i, j in zip(starts, ends)]
    a, b = (np.array(x) for x in zip(*minhash.permutations(8)))
    texts = [[f"{k}w{i}" for i in range(n)] for k, n in enumerate((0, 7, 8, 300, 8))]
    h = [{int(hashlib.md5(" ".join(t[i : i + 8]).encode()).hexdigest()[:8], 16) % minhash.PRIME for i in range(len(t) - 7)} for t in texts]
    expect = [([min((int(x) * v + int(y)) % minhash.PRIME for v in own) for x, y in zip(a, b)], len(t) - 7) if own else None for t, own in zip(texts, h)]
    assert minhash.signatures(texts, 8, a, b) == expect


def test_buckets_of_a_text_index_grow_with_its_documents(spark, monkeypatch):
    """One task sorts a bucket, so 64 buckets for any number of documents made its memory grow with them (F21)."""
    monkeypatch.setattr(search, "BUCKET_DOCS", 10)
    docs = spark.range(2000).selectExpr("cast(id as string) AS id", "'text' AS extracted_text")
    assert search.buckets_for(docs) == 200 and search.buckets_for(docs.limit(15)) == max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_rounds_of_capped_groups_have_tasks_of_a_bounded_size(spark, monkeypatch):
    """A task got up to 128 MB of compressed edges, whose rows it sorts, and shuffles had as many partitions whatever the edges (F15)."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")
    before, write, seen = {k: spark.conf.get(k) for k in names}, staging.stage, []

    def kept(df, name):
        seen.append((name, *(spark.conf.get(k) for k in names)))
        return write(df, name)

    monkeypatch.setattr(capped, "stage", kept)
    monkeypatch.setattr(staging, "TASK_ROWS", 50)
    edges = spark.createDataFrame([("hub", f"leaf{i:03}") for i in range(300)], "doc_id_a string, doc_id_b string")
    members, refused = capped.capped_groups(edges, 20)
    assert {k: spark.conf.get(k) for k in names} == before
    assert members.count() == 20 and refused.count() == 281
    assert seen[0][0] == "capped-all" and all(int(x[1]) <= 8 << 20 and int(x[2]) <= 16 << 20 for x in seen)
    assert len(seen) > 5 and {x[3] for x in seen[1:]} == {"12"}


def test_shingles_of_two_versions_are_written_side_by_side(spark, tmp_path):
    """Digests don't compress, and most of them are in both versions: one after the other, a long document's were written twice (F20)."""
    rng = random.Random(9)
    texts = [" ".join(rng.randbytes(3).hex() for _ in range(n)) for n in (5000, 4000, 0, 7, 8, 9, 11, 79, 80, 82, 155, 160)]
    texts += [None, " \n ", f"{texts[6]} [REDACTED] {texts[6]}", "One two  THREE\t" * 9]
    docs, out = tmp_path / "documents.parquet", tmp_path / "out"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(docs))
    # So few digests would all be in Parquet's dictionary.
    queries.QUERIES["shingles"](spark, str(tmp_path)).write.option("parquet.enable.dictionary", "false").parquet(str(out))
    got = duckdb.sql(f"SELECT id, place, shingle_md5 FROM '{out}/*.parquet'").fetchall()
    expect = duckdb.sql(queries.SQL["shingles"].replace("FROM documents", f"FROM '{docs}/*.parquet'")).fetchall()
    assert sorted(got) == sorted(expect) and len(got) > 17000
    # A digest is 32 characters, and its length takes 4.
    digests = duckdb.sql(f"SELECT sum(total_compressed_size) FROM parquet_metadata('{out}/*.parquet') WHERE path_in_schema = 'shingle_md5'").fetchall()[0][0]
    assert digests < 24 * len(got)
