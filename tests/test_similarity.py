import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.config import Settings
from palimpsest.functions import minhash
from palimpsest.operators import capped, cells, grouping, similarity
from palimpsest.operators.components import connected_components
from palimpsest.plans import fixtures


def longest_runs(a, b, k):
    """Stretches of a covered by common strings of at least k characters, by comparing all places."""
    spans = []
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= k:
                spans.append((i, i + n))
    out = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40), st.integers(2, 5))
def test_common_runs(a, b, k):
    assert similarity.common_runs(a, b, k) == longest_runs(a, b, k)


def test_min_segment():
    assert [similarity.min_segment(n) for n in (5, 19999, 30000, 10**6)] == [10, 10, 15, 50]


def test_signatures_estimate_jaccard():
    rng = random.Random(1)
    a, b = (np.array(x) for x in zip(*minhash.permutations(128)))
    for share in (0.3, 0.6, 0.9):
        words = [str(rng.random()) for _ in range(400)]
        other = words[: int(400 * share)] + [str(rng.random()) for _ in range(int(400 * (1 - share)))]
        x, y = minhash.signature(words, 1, a, b)[0], minhash.signature(other, 1, a, b)[0]
        j = len(set(words) & set(other)) / len(set(words) | set(other))
        est = np.mean(np.array(x) == np.array(y))
        assert abs(est - j) <= 3 * np.sqrt(j * (1 - j) / 128) + 1e-9


def docs_of(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, extracted_text string")


def test_candidates_and_verification(spark):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    masked = words[:]
    masked[100] = "[REDACTED]"
    other = [f"v{rng.randint(0, 10**6)}" for _ in range(300)]
    docs = docs_of(spark, [" ".join(words), " ".join(masked), " ".join(other), "too short", None])
    pairs = similarity.candidate_pairs(docs)
    assert [tuple(r) for r in pairs.collect()] == [("0", "1")]
    (row,) = similarity.verified_pairs(pairs, docs).collect()
    assert row.common_len > 500 and row.similarity < 1
    assert similarity.candidate_pairs(docs, grouped=spark.createDataFrame([("0",)], "id string")).count() == 0


def test_recall_against_all_pairs(spark):
    """Versions about as similar as the threshold: of all pairs at 0.70 or more, nine in ten at least are candidates."""
    docs = fixtures.versions(spark, "/root/testdata/sf0.001", every=97, a=3, b=51).select("id", "extracted_text").cache()
    own = {}
    for r in docs.where("extracted_text IS NOT NULL").collect():
        words = r.extracted_text.replace("[REDACTED]", " ").replace("[b(6)]", " ").lower().split()
        own[r.id] = {" ".join(words[i : i + 8]) for i in range(len(words) - 7)}
    holding = {}
    for i, shingles in own.items():
        for s in shingles:
            holding.setdefault(s, []).append(i)
    common = Counter(tuple(sorted(p)) for ids in holding.values() for p in combinations(ids, 2))
    similar = {p for p, n in common.items() if n >= 0.7 * (len(own[p[0]]) + len(own[p[1]]) - n)}
    found = {(r.doc_id_a, r.doc_id_b) for r in similarity.lsh_candidates(minhash.fingerprints(docs)).collect()}
    near = [n / (len(own[a]) + len(own[b]) - n) for (a, b), n in common.items() if (a, b) in similar]
    assert len(similar) > 100 and sorted(near)[len(near) // 2] < 0.8
    assert len(similar & found) >= 0.9 * len(similar)


def test_overlap_gates(spark):
    shared = "".join(random.Random(5).choices("abcdefghij ", k=300))
    texts = ["left " + shared, shared + " [REDACTED] right", "more " + shared]
    docs = docs_of(spark, texts)
    pairs = spark.createDataFrame([("0", "1"), ("0", "2")], "doc_id_a string, doc_id_b string")
    assert [r.doc_id_b for r in similarity.verified_pairs(pairs, docs).collect()] == ["1"]


def test_header_buckets(spark):
    head = "From: a@x\nTo: b@x\nSubject: s{}\n\nbody"
    docs = docs_of(spark, [head.format(1), head.format(2), "From: a@x\nSubject: z", "no header"])
    found = similarity.header_edges(docs).collect()
    assert [(r.doc_id_a, r.doc_id_b, r.similarity) for r in found] == [("0", "1", 1.0)]
    few = Settings(header_limit=1)
    assert similarity.header_edges(docs, few).count() == 0
    three = Settings(header_matches=3)
    assert similarity.header_edges(docs, three).count() == 0


def plain_components(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {x: top(x) for x in parent}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    expect = plain_components([e for e in edges if e[0] != e[1]])
    assert got == expect
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_groups_in_order_and_at_scale(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("b", "c"), ("d", "e")], "doc_id_a string, doc_id_b string")
    rows = grouping.group_in_order(edges, cap=2).collect()
    groups = {r.doc_id: r.group_id for r in rows if r.pair is None}
    assert groups["a"] == groups["b"] != groups["c"] == groups["d"] and "e" not in groups
    assert {(r.doc_id, r.pair) for r in rows if r.pair} == {("b", "c"), ("d", "e")}
    members, cross = grouping.group_documents(edges)
    assert {r.group_id for r in members.collect()} == {"a"} and cross.count() == 0


def by_group(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.group_id, set()).add(r.doc_id)
    return groups


@pytest.mark.parametrize(("cap", "seed"), [(3, 1), (5, 2), (8, 3), (1000, 4)])
def test_capped_groups(spark, cap, seed):
    rng = random.Random(seed)
    pairs = {(str(rng.randint(0, 150)), str(rng.randint(0, 150))) for _ in range(170)} | {("hub", str(i)) for i in range(40)} | {(f"p{i:02}", f"p{i + 1:02}") for i in range(30)}
    rows = [*pairs, *[(b, a) for a, b in list(pairs)[:20]], ("x", "x"), (None, "1"), ("1", None)]
    edges = spark.createDataFrame(rows, "doc_id_a string, doc_id_b string")
    members, refused = (x.collect() for x in capped.capped_groups(edges, cap))
    of = {r.doc_id: r.group_id for r in members}
    groups = by_group(members)
    assert len(of) == len(members) and all(g == min(ds) and 2 <= len(ds) <= 2 * cap - 2 for g, ds in groups.items())
    plain = {tuple(sorted(e)) for e in pairs if e[0] != e[1]}
    across = {(a, b) for a, b in plain if of.get(a, a) != of.get(b, b)}
    assert {(r.doc_id_a, r.doc_id_b) for r in refused} == across and len(refused) == len(across)
    # An edge is refused only where a group is full, and a group hangs together by edges of its own.
    assert all(max(len(groups.get(of.get(x), ())) for x in e) >= cap for e in across)
    tops = plain_components([e for e in plain if e not in across])
    assert all(len({tops[d] for d in ds}) == 1 for ds in groups.values())
    if cap == 1000:
        in_order = grouping.group_in_order(spark.createDataFrame(sorted(plain), "doc_id_a string, doc_id_b string"), cap).collect()
        assert not refused and sorted(map(sorted, groups.values())) == sorted(map(sorted, by_group(in_order).values()))


def test_capped_groups_take_the_least_edges(spark):
    star = spark.createDataFrame([("hub", f"leaf{i:03}") for i in range(300)], "doc_id_a string, doc_id_b string")
    members, refused = capped.capped_groups(star, 20)
    assert members.count() == 20 and refused.count() == 281
    none = spark.createDataFrame([], star.schema)
    assert [x.count() for x in capped.capped_groups(none, 20)] == [0, 0]


def test_split_groups(spark):
    rng = random.Random(6)
    texts = []
    for family in range(2):
        words = [f"f{family}w{rng.randint(0, 10**6)}" for _ in range(200)]
        texts += [" ".join(words[:190] + [f"x{k}"] * 3) for k in range(3)]
    texts.append("lonely " * 20)
    docs = docs_of(spark, texts)
    members = docs.select(grouping.F.lit("g").alias("group_id"), grouping.F.col("id").alias("doc_id"))
    prints = minhash.fingerprints(docs)
    got = {r.doc_id: r.group_id for r in grouping.split_groups(members, prints, Settings(split_above=4)).collect()}
    assert got == {"0": "0", "1": "0", "2": "0", "3": "3", "4": "3", "5": "3"}
    kept = grouping.split_groups(members, prints, Settings(split_above=50)).collect()
    assert len(kept) == 7 and {r.group_id for r in kept} == {"g"}
    none = prints.where("false")
    assert grouping.split_groups(members, none, Settings(split_above=4)).count() == 7


def test_texts_of_a_cluster_travel_by_cell(spark, monkeypatch):
    """F9 to F12: 60 near copies have 1,770 pairs, whose texts travelled 3,540 times; cells get each once, and count as pairs by themselves do."""
    base = [f"w{i}" for i in range(300)]
    texts = {f"{k:02}": " ".join([*base[:k], f"x{k}", *base[k + 1 :], *(["[REDACTED]"] if k % 2 else [])]) for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "id string, extracted_text string")
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "doc_id_a string, doc_id_b string")
    monkeypatch.setattr(cells, "CELL_SIZE", 40_000)
    met = cells.dealt(pairs, docs.select("id", F.length("extracted_text").alias("size"))).collect()
    assert len(met) == 1770 and len({r.cell for r in met}) > 1
    assert len({(r.cell, i) for r in met for i in (r.doc_id_a, r.doc_id_b)}) < 600
    stripped = {i: t.replace("[REDACTED]", " ").strip() for i, t in texts.items()}
    found = {(r.doc_id_a, r.doc_id_b): (r.n_segments, r.common_len, r.complementary) for r in similarity.segments(pairs, docs).collect()}
    assert len(found) == 1770
    for (a, b), (n, size, apart) in found.items():
        runs = similarity.common_runs(stripped[a], stripped[b], 10)
        assert (n, size, apart) == (len(runs), sum(z - s for s, z in runs) + len(runs) - 1, int(a) % 2 != int(b) % 2)
