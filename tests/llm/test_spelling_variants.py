import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.spelling_variants import edit_keys, forms, near_pairs, roots, spelling_variants, vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether one edit divides two strings, by trying all of them."""
    if a == b:
        return False
    cut = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
    if len(a) == len(b):
        return any(a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(a)))
    return a in cut(b) or b in cut(a)


def plain_vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def plain_variants(n):
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in close.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(close[w]), form[w] and n[form[w]]) for w in n}


ORDER = {a + b: (i * 7 + j * 3) % 5 * 100 + i * 10 + j for i, a in enumerate("abcd") for j, b in enumerate("abcd")}


@settings(max_examples=400, deadline=None)
@given(st.text("abcd", min_size=7, max_size=14), st.integers(0, 14), st.sampled_from(["cut", "put", "change"]), st.sampled_from("abcd"))
def test_near_words_share_a_key(word, place, edit, letter):
    place = min(place, len(word) - 1)
    other = {"cut": word[:place] + word[place + 1 :], "put": word[:place] + letter + word[place:], "change": word[:place] + letter + word[place + 1 :]}[edit]
    if len(other) >= 7:
        assert set(edit_keys(word, ORDER)) & set(edit_keys(other, ORDER))


@settings(max_examples=200, deadline=None)
@given(st.sampled_from("ab"), st.integers(7, 20), st.integers(0, 20), st.sampled_from("abc"))
def test_repeated_letters_share_a_key(letter, length, place, put):
    word = letter * length
    for other in (word + letter, word[:place] + put + word[place:], word[:place] + put + word[place + 1 :]):
        assert set(edit_keys(word, ORDER)) & set(edit_keys(other, ORDER))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = plain_vocabulary([(r.doc_id, r.text) for r in docs.collect()])
    words = vocabulary(docs)
    assert {r.word: r.n for r in words.collect()} == n
    # By lost letters, since all pairs of these words are too many to try.
    by_rest = {}
    for w in n:
        for i in range(len(w)):
            by_rest.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    pairs = {(a, b) for group in by_rest.values() for a in group for b in group if a < b and near(a, b)}
    pairs |= {tuple(sorted((w, x))) for w in n for i in range(len(w)) for x in [w[:i] + w[i + 1 :]] if x in n}
    assert {(r.a, r.b) for r in near_pairs(words).collect()} == pairs


def test_small_tables(spark, documents):
    base = ["straße", "variant", "variants", "varient", "aaaaaaa", "aaaaaaaa", "àéîõüÿx", "ÀÉÎÕÜŸX"]
    rows = [(i, " ".join(w for k, w in enumerate(base) for _ in range(1 + (i * 3 + k) % 4 + (40 if w == "variant" else 0)))) for i in range(12)]
    rows += [(None, "variants Variants VARIANTS,variants"), (5, None), (6, ""), (7, "vari" + "a" * 30000 + "nt " + "vari" + "a" * 30001 + "nt"), (7, "vari" + "a" * 30000 + "nt " + "vari" + "a" * 30001 + "nt")]
    docs = documents(rows).withColumnRenamed("lang", "word").withColumnRenamed("n_chars", "n")
    n = plain_vocabulary(rows)
    got = spelling_variants(vocabulary(docs))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain_variants(n)
    assert any(r.form == "variant" for r in got.collect())


def test_forms_ties_and_chains(spark):
    words = {"aaaaaaab": 1, "aaaaaaac": 10, "aaaaaaad": 10, "aaaaaaacx": 100, "zzzzzzz": 5, "zzzzzzzy": 49, "aaaaaacx": 1000, "aaaaaacxx": 1}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in spelling_variants(table).collect()} == plain_variants(words)
    got = {r.word: r for r in forms(table).collect()}
    assert got["aaaaaaab"].form == "aaaaaaac" and got["zzzzzzz"].form is None and got["zzzzzzz"].n_near == 1


def test_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(18)], "word string, form string")
    assert {(r.word, r.root) for r in roots(chain).collect()} == {(f"w{i:02}", "w18") for i in range(18)}


def test_empty(spark, documents):
    assert spelling_variants(vocabulary(documents([]))).count() == 0
    assert spelling_variants(vocabulary(documents([(1, "short words only 1234567 x")]))).count() == 0
