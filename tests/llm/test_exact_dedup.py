import hashlib
import random

from palimpsest.llm import exact_dedup
from palimpsest.llm.exact_dedup import DigestIndex, dedup_batch
from palimpsest.staging import new_path


def index(spark):
    return DigestIndex(spark, new_path(spark, "test-index"), buckets=4)


def test_one_batch(spark, documents):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "", None, "A", f"own {i}", "x" * 100000])) for i in range(200)]
    got = {r.doc_id: r for r in dedup_batch(documents(rows).withColumnRenamed("lang", "digest").withColumnRenamed("source", "keep_id"), index(spark)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == 200
    for i, t in rows:
        own = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_later_batches_meet_the_index(spark, documents):
    own = index(spark)
    dedup_batch(documents([(1, "a"), (2, "b")]), own).collect()
    got = {r.doc_id: (r.keep_id, r.kept, r.seen_before) for r in dedup_batch(documents([(3, "a"), (4, "c"), (5, "c")]), own).collect()}
    assert got == {3: (1, False, True), 4: (5, False, False), 5: (5, True, False)}
    again = DigestIndex(spark, own.path, buckets=4)
    assert again.read().count() == 3


def test_the_index_is_read_without_a_shuffle(spark, documents):
    own = index(spark)
    dedup_batch(documents([(1, "a")]), own).collect()
    batch = exact_dedup.with_digest(documents([(2, "a")])).select("digest").repartition(4, "digest")
    plan = batch.join(own.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_nulls_repeats_and_empty(spark, documents):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup_batch(documents([(None, "a"), (3, "a"), (3, "a"), (None, "n"), (None, "n")]), index(spark)).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 2, True), (None, None, 2, True)], key=str)
    assert dedup_batch(documents([]), index(spark)).count() == 0


def test_a_batch_that_is_run_again(spark, documents):
    """As after a failed write: the verdicts are the same, and the index has each digest once."""
    own = index(spark)
    dedup_batch(documents([(1, "a")]), own, "first").collect()
    batch = documents([(2, "a"), (3, "b"), (4, "b"), (5, "c")])
    once = sorted(map(tuple, dedup_batch(batch, own, "second").collect()))
    assert [r[3] for r in once] == [False, False, True, True]
    assert sorted(map(tuple, dedup_batch(batch, own, "second").collect())) == once
    assert sorted(map(tuple, dedup_batch(batch, DigestIndex(spark, own.path), "second").collect())) == once
    assert own.read().count() == 3
    assert not any(r.kept for r in dedup_batch(batch, own, "third").collect())


def test_a_batch_that_was_appended_in_part(spark, documents):
    own = index(spark)
    dedup_batch(documents([(3, "b")]), own, "one").collect()
    got = {r.doc_id: r.kept for r in dedup_batch(documents([(3, "b"), (5, "c")]), own, "one").collect()}
    assert got == {3: True, 5: True} and own.read().count() == 2


def test_indexes_with_one_last_name(spark, documents):
    top = new_path(spark, "two")
    a, b = DigestIndex(spark, f"{top}/a/index"), DigestIndex(spark, f"{top}/b/index")
    dedup_batch(documents([(1, "x")]), a).collect()
    assert [r.kept for r in dedup_batch(documents([(2, "x")]), b).collect()] == [True]
    assert a.read().count() == b.read().count() == 1


def test_ten_appends_and_compaction(spark, documents):
    own = index(spark)
    for k in range(10):
        dedup_batch(documents([(i, f"text {i}") for i in range(10 * k, 10 * k + 10)]), own, str(k)).collect()
    before = sorted(map(tuple, own.read().collect()))
    assert len(before) == 100 and len(own.read().inputFiles()) > 10
    own.compact()
    assert sorted(map(tuple, own.read().collect())) == before and len(own.read().inputFiles()) <= 4
    own.compact(buckets=8)
    again = DigestIndex(spark, own.path, buckets=4)
    assert again.buckets == 8 and sorted(map(tuple, again.read().collect())) == before
    assert not any(r.kept for r in dedup_batch(documents([(500, "text 5")]), again).collect())


def test_stage_keeps_one_row(spark, documents):
    docs = documents([(3, "a"), (3, "a"), (1, "a"), (2, None), (4, "")])
    for name in ("digest", "kept_id", "KEPT_DIGEST", "keep_id", "seen_before"):
        own = docs.withColumnRenamed("lang", name)
        got = exact_dedup.stage_exact_dedup(spark, own, "")
        assert got.columns == own.columns
        assert sorted((r.doc_id, r.text, r[name]) for r in got.collect()) == [(3, "a", "en"), (4, "", "en")]
