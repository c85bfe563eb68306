import hashlib
import random
from collections import Counter

import pytest

from palimpsest.llm import suffix_dedup


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by counting every window."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(c for c, h in zip(t, hit) if not h)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n, length):
    parts = [rng.randbytes(rng.randint(length // 3, 3 * length)).hex()[: rng.randint(length // 2, 4 * length)] for _ in range(6)]
    parts += ["ab" * length, "é" * (length // 2 + 3), "x" * (2 * length)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(parts)
            if rng.random() < 0.3:
                p = p[rng.randint(0, len(p)) :]
            if rng.random() < 0.3:
                k = rng.randint(0, len(p))
                p = p[:k] + "#" + p[k:]
            t += p + rng.randbytes(rng.randint(0, length // 2)).hex() * rng.randint(0, 1)
        texts.append(t)
    return texts + texts[:2]


@pytest.mark.parametrize(("seed", "length"), [(1, 400), (2, 400), (3, 40)])
def test_against_every_window(spark, documents, seed, length):
    texts = corpus(random.Random(seed), 40, length)
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(documents(list(enumerate(texts))), length).collect()}
    expect = plain([t.encode() for t in texts], length)
    assert [got[i] for i in range(len(texts))] == expect
    assert sum(e[1] for e in expect) > 1000


def test_blocks_do_not_show(monkeypatch):
    rng = random.Random(4)
    text = (rng.randbytes(3000).hex() + "q" * 900 + rng.randbytes(200).hex() * 3).encode()
    whole = [x.tolist() for x in suffix_dedup.phrases(text)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 333)
    assert [x.tolist() for x in suffix_dedup.phrases(text)] == whole


def test_edge_cases(spark, documents):
    t = "z" * 1000
    docs = documents([(1, None), (2, ""), (3, t), (None, t), (3, t), (4, "short"), (5, "y" * 399 + "é")]).withColumnRenamed("lang", "uid").withColumnRenamed("source", "spans")
    rows = sorted(suffix_dedup.remove_repeats(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows] == [
        (1, 0, 0, 0), (2, 0, 0, 0), (3, 1000, 1000, 1), (3, 1000, 1000, 1), (4, 5, 0, 0), (5, 401, 0, 0), (None, 1000, 1000, 1)
    ]
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def test_stage_takes_passages_of_over_50_words(spark, documents):
    """Whatever their bytes and the white space between them; passages of 50 words stay, as do those that occur once."""
    rng = random.Random(5)
    words = lambda n, k=5: [rng.randbytes(k).hex()[:k] for _ in range(n)]
    p51, p50, long, twice = words(51), words(50), words(300, 3), words(51, 4)
    own = [" ".join(words(rng.randint(20, 60))) for _ in range(20)]
    # White space differs around the copies, so that no string of 400 bytes goes beyond the words.
    around = [" ", "\n", " ", "\n", " ", "\n", " "]
    texts = [f"{own[i]}{s}{' '.join(p)}{s}{own[i + 10]}" for i, (s, p) in enumerate(zip(around, (p51, p51, p50, p50, long, long, words(80))))]
    texts += [f"{own[7]} \u00e9\n" + "\n".join(p51), f"{own[8]} {' '.join(twice)} {own[9]} {'  '.join(twice)}", None, "", " "]
    assert all(len(" ".join(p)) < 400 for p in (p51, twice)) and len(" ".join(long)) > 400
    expect = dict(enumerate(texts)) | {i: own[i] + 2 * around[i] + own[i + 10] for i in (0, 1, 4, 5)}
    expect |= {7: f"{own[7]} \u00e9\n", 8: f"{own[8]}  {own[9]} "}
    rows = suffix_dedup.stage_suffix_dedup(spark, documents(list(enumerate(texts))).withColumnRenamed("lang", "passages"), "").collect()
    assert {r.doc_id: r.text for r in rows} == expect
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_against_every_window_of_words(spark, seed):
    rng, length = random.Random(seed), suffix_dedup.PASSAGE
    vocabulary = [f"w{i}" for i in range(300)]
    parts = [rng.choices(vocabulary, k=rng.randint(30, 200)) for _ in range(6)] + [["a", "b"] * 60, ["x"] * 120]
    texts = []
    for _ in range(40):
        t = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(parts)
            t += p[rng.randint(0, len(p)) if rng.random() < 0.3 else 0 :] + rng.choices(vocabulary, k=rng.randint(0, 20))
        texts.append(t)
    seen = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    expect = {(n, i) for n, t in enumerate(texts) for i in range(len(t) - length + 1) if seen[tuple(t[i : i + length])] > 1}
    rows = spark.createDataFrame([(n, rng.choice([" ", "\n", " \t"]).join(t)) for n, t in enumerate(texts)], "uid long, text string")
    got = {(r.uid, i) for r in suffix_dedup.repeats(rows, length, suffix_dedup.WORD).collect() for i in range(r.lo, r.hi + 1)}
    assert got == expect and len(got) > 1000


def test_stage_writes_each_table_once(spark, documents, monkeypatch):
    """Bytes and words go through the same tables: each file written is a process that an executor starts."""
    written, stage = Counter(), suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, name: written.update([name]) or stage(df, name))
    rng = random.Random(6)
    words = " ".join(rng.randbytes(2).hex() for _ in range(60))
    run = "".join(rng.choice("abcdefgh") for _ in range(500))
    texts = [f"one {words} of", f"two\t{words}\tby", f"p{run}q", f"r{run}s"]
    rows = suffix_dedup.stage_suffix_dedup(spark, documents(list(enumerate(texts))), "").collect()
    assert {r.doc_id: r.text for r in rows} == {0: "one  of", 1: "two\t\tby", 2: "pq", 3: "rs"}
    assert set(written.values()) == {1}


def plain_passages(texts, length=suffix_dedup.PASSAGE):
    """(n_passages, n_passage_words) of each text, by counting every window of words."""
    texts = [t.encode().split() for t in texts]
    seen = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[tuple(t[i : i + length])] > 1:
                hit[i : i + length] = b"\1" * length
        out.append((sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit)), sum(hit)))
    return out


def test_query_counts_passages_of_over_50_words_that_stay(spark, documents, tmp_path):
    """Passages too short for 400 bytes are told apart from what occurs once, and none of their bytes go."""
    rng = random.Random(7)
    words = lambda n: [rng.randbytes(3).hex()[:5] for _ in range(n)]
    own = [words(rng.randint(60, 120)) for _ in range(60)]
    texts = [" ".join(o) for o in own]
    planted = {}
    for k in range(10):
        passage = words(rng.randint(51, 60))
        assert len(" ".join(passage)) < 400
        for i in (2 * k, 2 * k + 1):
            at, planted[i] = rng.randint(0, len(own[i])), len(passage)
            texts[i] = " ".join(own[i][:at] + ["\n".join(passage) if i % 2 else " ".join(passage)] + own[i][at:])
    # A passage of 50 words stays uncounted; one twice in a text counts both times; null and empty have none.
    fifty, twice = " ".join(words(50)), " ".join(words(51))
    texts += [f"{fifty} a", f"{fifty} b", f"c {twice} d {twice} e", None, ""]
    documents(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in suffix_dedup.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    expect = {i: (1, n) for i, n in planted.items()} | {62: (2, 102)}
    assert {i: (r.n_passages, r.n_passage_words) for i, r in rows.items()} == {i: expect.get(i, (0, 0)) for i in range(len(texts))}
    # By the contract's 400 bytes nothing is removed here.
    assert [tuple(rows[i])[1:5] for i in range(len(texts))] == plain([(t or "").encode() for t in texts], 400)
    assert not any(r.n_removed for r in rows.values())


@pytest.mark.parametrize("seed", [8, 9])
def test_passages_and_bytes_in_one_run(spark, documents, seed):
    rng = random.Random(seed)
    texts = corpus(rng, 25, 400)
    parts = [rng.choices("abcdefgh", k=rng.randint(30, 200)) for _ in range(4)]
    texts += ["\u00e9 " + rng.choice([" ", "\n"]).join(rng.choice(parts) + rng.choices("xyz", k=rng.randint(0, 9)) + rng.choice(parts)) for _ in range(15)]
    got = {r.doc_id: tuple(r) for r in suffix_dedup.remove_repeats(documents(list(enumerate(texts)))).collect()}
    assert [got[i][1:5] for i in range(len(texts))] == plain([t.encode() for t in texts], 400)
    expect = plain_passages(texts)
    assert [got[i][6:] for i in range(len(texts))] == expect and sum(n for _, n in expect) > 500
