"""Each stage of the pipeline against a plain version of it, on what its predecessor kept."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from palimpsest.llm import packing
from tests.llm.test_packing import check
from tests.llm.test_quality_rules import plain as plain_measures
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(docs):
    lines = lambda t: [" ".join(x.split()).lower() for x in t.split("\n") if x.split()]
    having, texts = defaultdict(set), defaultdict(set)
    for d in docs:
        texts[d["source"]].add(d["text"])
        for x in lines(d["text"]):
            having[d["source"], x].add(d["text"])
    bad = {k for k, v in having.items() if len(v) > 20 or len(v) >= 5 and 100 * len(v) > len(texts[k[0]])}
    out = {}
    for d in docs:
        n, *_, failed = plain_measures(d["text"])
        gone = sum(len(x.split()) for x in lines(d["text"]) if (d["source"], x) in bad)
        if not failed and 100 * (n - gone) >= 70 * n:
            out[d["doc_id"]] = "\n".join(x for x in d["text"].split("\n") if (d["source"], " ".join(x.split()).lower()) not in bad)
    return out


def exact(docs):
    last = {}
    for d in docs:
        last[d["text"]] = max(last.get(d["text"], -1), d["doc_id"])
    return {i: t for t, i in last.items()}


def simhash(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    tops = plain_components([plain_fingerprint(d["text"]) for d in docs])
    return {d["doc_id"]: d["text"] for i, d in enumerate(docs) if tops[i] == i}


def suffix(docs, length=400, passage=51):
    """Every byte goes that a string of 400 bytes or a passage of 51 words covers which also starts elsewhere."""
    raw = {d["doc_id"]: d["text"].encode() for d in docs}
    words = {k: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for k, t in raw.items()}
    own = lambda k, i: tuple(raw[k][a:z] for a, z in words[k][i : i + passage])
    seen = Counter(hash(t[i : i + length]) for t in raw.values() for i in range(len(t) - length + 1))
    passages = Counter(hash(own(k, i)) for k in raw for i in range(len(words[k]) - passage + 1))
    out = {}
    for k, t in raw.items():
        keep, end, parts = bytearray(b"\1" * len(t)), 0, []
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                keep[i : i + length] = bytes(length)
        for i in range(len(words[k]) - passage + 1):
            if passages[hash(own(k, i))] > 1:
                first, last = words[k][i][0], words[k][i + passage - 1][1]
                keep[first:last] = bytes(last - first)
        while end < len(t):
            start = keep.find(1, end)
            if start < 0:
                break
            end = keep.find(0, start)
            end = len(t) if end < 0 else end
            parts.append(t[start:end].decode(errors="ignore"))
        out[k] = "".join(parts)
    return out


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input rows and output rows of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        made = step(spark, docs, SF)
        made.write.parquet(path)
        after = spark.read.parquet(path)
        out.append(([r.asDict() for r in docs.collect()], after.columns, after.collect()))
        docs = after
    return out


@pytest.mark.parametrize(("k", "plain"), [(0, quality), (1, exact), (2, simhash), (3, suffix)])
def test_stage(steps, k, plain):
    before, columns, after = steps[k]
    assert columns == COLUMNS
    assert {r.doc_id: r.text for r in after} == plain(before)
    assert len(after) == len({r.doc_id for r in after})
    assert all(r.n_chars == len(r.text) for r in after) or k in (1, 2)


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    t.encode_special_tokens = True
    before, columns, after = steps[4]
    assert columns == packing.PIECE
    check(t, [(d["doc_id"], d["text"]) for d in before], after)


def test_empty_and_odd_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, "").count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, "", "x", None, 0)], docs.schema)
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, odd, "").columns == COLUMNS
        step(spark, odd, "").collect()
