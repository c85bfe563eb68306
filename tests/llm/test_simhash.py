import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return [top(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ABéİ \t\n\x0b ", max_size=60))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


def test_masks_hide_any_four_bits():
    masks = simhash.covering_masks()
    rng = random.Random(1)
    assert len(masks) == 31
    for _ in range(3000):
        bits = rng.sample(range(64), 4)
        assert any(all(not m >> b & 1 for b in bits) for m in masks)


def chains(rng, n):
    """Fingerprints in dense balls and in chains of steps of up to five bits."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            out.append(x)
            y = x
            for b in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << b
            x = y if rng.random() < 0.6 else out[-1]
    return out[:n]


@pytest.mark.parametrize("max_bucket", [1 << 16, 3])
def test_links_give_the_plain_components(spark, max_bucket):
    fps = chains(random.Random(5), 500)
    expect = plain_components(fps)
    signed = [simhash._signed(x) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bucket=max_bucket)
    got = {r.node: r.component for r in simhash.connected_components(edges).collect()}
    groups = {}
    for s, e in zip(signed, expect):
        assert groups.setdefault(got.get(s, s), e) == e
    assert len(groups) == len(set(expect))


def test_edge_cases(spark, documents):
    long = " ".join(f"w{i}" for i in range(70000))
    docs = documents([(3, None), (1, ""), (2, " \t"), (5, long), (4, long), (4, long), (None, "a b c d e"), (9, "A b  c d E")])
    docs = docs.withColumnRenamed("lang", "fp").withColumnRenamed("n_chars", "component")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[1].fp == rows[3].fp == 0
    assert rows[1].component_id == rows[2].component_id == rows[3].component_id == 1
    assert rows[5].component_id == rows[4].component_id == 4
    assert rows[None].component_id == rows[9].component_id == 9
    assert rows[5].fp % 2**64 == plain_fingerprint(long)
    assert simhash.near_duplicates(documents([])).count() == 0
    kept = simhash.stage_simhash(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]


def test_stars_reach_chains():
    a = np.array([0, 0b1111, 0b11111111, 1 << 60 | 0b111 << 40 | 1 << 63 | 0b11 << 30], np.uint64)
    (members, root), = simhash.stars(a)
    assert root == 0 and sorted(members.tolist()) == [0b1111, 0b11111111]
