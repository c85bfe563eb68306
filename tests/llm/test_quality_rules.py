import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import quality_rules as q

SPACE = " \t\n\x0b\x0c\r"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), failed)


def measured(spark, documents, texts):
    rows = q.judge(documents(list(enumerate(texts))), bad=spark.createDataFrame([], "line_key long")).collect()
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}


def test_measures(spark, documents):
    rng = random.Random(2)
    texts = [None, "", " \n\n", "a b c a b c", "\n a\n a\na\n", "x" * 50000, "w " * 40000, "é#*$%&|<>ß\x85z\xa0y"]
    texts += ["".join(rng.choice(["ab", "c", " ", "\n", "\t", "#", "é", "\r", "\x0b", "  "]) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    got = measured(spark, documents, texts)
    assert got == {i: plain(t) for i, t in enumerate(texts)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab c\n", max_size=60), min_size=1, max_size=30))
def test_measures_of_any_text(spark, texts):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in q.measures(docs).collect()}
    assert got == {i: plain(t)[4] for i, t in enumerate(texts)}


def body(i, n=60):
    return " ".join(f"d{i}w{k}" for k in range(n))


def test_boilerplate_goes_and_depleted_documents_too(spark, documents):
    menu = "Home About  Contact " * 5
    rows = [(i, f"{menu}\n{body(i)}", "h") for i in range(30)]
    rows += [(100, menu.lower() + "\n" + " ".join(["home about contact"] * 5) + "\n" + body(1, 50), "h")]
    rows += [(200, f"{menu}\n{body(1)}", "other"), (300, body(2) + "\n" + body(3), None)]
    got = {r.doc_id: r for r in q.judge(documents(rows)).collect()}
    assert got[0].removed_words == 15 and got[200].removed_words == 0
    assert got[200].kept and got[300].kept and all(got[i].kept for i in range(30))
    assert got[100].removed_words == 30 and not got[100].kept and not got[100].base_failed
    for name in ("line_keys", "uid", "kept_uid", "KEPT_ID", "removed_words"):
        own = documents(rows).withColumnRenamed("lang", name)
        cleaned = q.clean(own)
        assert cleaned.columns == own.columns
        texts = {r.doc_id: r for r in cleaned.collect()}
        assert texts[5].text == body(5) and texts[5].n_chars == len(body(5)) and texts[5][name] == "en"
        assert texts[200].text == rows[31][1] and 100 not in texts


def test_depleted_documents_are_rejected_in_hosts_of_any_size(spark, documents):
    """A page of menu lines with a few words of its own, in a host of 12 documents, of 120 and of 2,400."""
    rows, planted = [], []
    for host, n in (("small", 12), ("middle", 120), ("large", 2400)):
        lines = [f"{host} menu line {k} " + " ".join(f"entry{k}x{j}" for j in range(12)) for k in range(4)]
        # Held by 8 documents of the small host and the middle one, and by 1 in 100 of the large one.
        holders = 8 if n < 1000 else n // 100
        for i in range(n):
            own = lines[i % 4] + "\n" if i < 4 * holders and n >= 4 * holders else (lines[i % 4] + "\n" if i < holders else "")
            rows.append((len(rows), own + body(len(rows)), host))
        for k in range(6):
            planted.append(len(rows))
            rows.append((len(rows), "\n".join(lines) + "\n" + body(len(rows), 40), host))
    got = {r.doc_id: r for r in q.judge(documents(rows)).collect()}
    assert not any(got[i].kept or got[i].base_failed for i in planted)
    assert all(got[i].kept for i, *_ in rows if i not in planted)


def test_copies_count_once(spark, documents):
    rows = [(i, body(0) + "\n" + body(1), "h") for i in range(60)] + [(100, body(5), "h")]
    assert all(r.kept and r.removed_words == 0 for r in q.judge(documents(rows)).collect())


def test_repeated_rows_nulls_and_empty(spark, documents):
    menu = "one two three four"
    rows = [(i, f"{menu}\n{body(i)}", None) for i in range(25)] + [(1, f"{menu}\n{body(1)}", None), (None, None, None)]
    got = q.judge(documents(rows)).collect()
    assert len(got) == 27
    assert sorted(r.removed_words for r in got) == [0, *[4] * 26]
    assert q.judge(documents([])).count() == 0
