r"""Spelling variants: words of a corpus that one edit divides, the rarer named by the far more frequent.

A word's bigrams are ordered by how many words hold them, the rarest first, over
the whole vocabulary.  One edit takes at most two bigrams from a word, and what
is left keeps its order, so that two near words have one of their three rarest
bigrams in common, at the same place or one off.  Only those three are joined.
The place limits the join further: the edit is left or right of the common
bigram, so that the other side is equal as a whole; and it is in the first or
the second half of its own side, so that the other half is equal, too.  A row
for each of these cases is keyed by all that the edit must leave equal, and each
pair of words that meet is verified.

Words are counted by Spark's own expressions; the keys are made in Arrow batches
with the order of the bigrams, which is bounded by the alphabet: 90 letters, so
8,100 bigrams.  No other table is sent to all tasks.  Frequent words are added
up before they are shuffled; keys belong to distinct words, so none grows with
the rows of the corpus.

The chain of forms of a word is no longer than the digits of the largest count,
as each form is ten times as frequent; it is followed by pointer jumping.

Defined cases: a null text has no words; a null doc_id is an empty string where
runs are chosen; repeated rows and equal texts count each for itself; ties among
forms go to the least in code-point order; an empty table gives an empty result;
words of any length are compared whole; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.staging import drop, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points and occurrences that a word has at least, and how many times as frequent its form is.
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: One in so many runs loses a letter.
DAMAGED = 31
#: Bigrams of a word that are joined: one edit takes two of them, one is left.
RAREST = 3
#: Words whose keys one task makes.
WORDS_A_TASK = 50_000


def damaged(doc_id, run):
    """The run, without one letter where the checksum of document and run says so (columns)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, damage: bool = True, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all texts; ``damage``: with a letter lost in some runs."""
    # A run that is too short stays so.  Matching takes all letters that follow, so runs are maximal.
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    word = damaged(F.col("doc_id"), F.col("run")) if damage else F.col("run")
    return rows.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The rank of each bigram, the rarest first; as many entries as the alphabet has pairs, at most."""
    grams = F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")
    counted = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").count().collect()
    return {r.gram: i for i, r in enumerate(sorted(counted, key=lambda r: (r["count"], r.gram)))}


def edit_keys(word: str, order: dict[str, int]) -> Iterator[tuple[str, str, str]]:
    """(case, what is equal beside the bigram, what is equal of the edited side) for each place where an edit may be."""
    places = sorted(range(len(word) - 1), key=lambda i: (order[word[i : i + 2]], i))[:RAREST]
    for p in places:
        for side, equal, edited in (("<", word[p:], word[:p]), (">", word[: p + 2], word[p + 2 :])):
            n = len(edited)
            # Of two sides of n letters the first n // 2 or the others are equal.  Of n and n + 1, counted by the shorter one, too:
            # so each side is cut as the shorter (or equal) one of a pair, and as the longer one.
            for first in {n // 2, max(n - 1, 0) // 2}:
                yield side + "1", equal, edited[:first]
            for last in {n - n // 2, n // 2}:
                yield side + "2", equal, edited[n - last :]


def _keyed(order: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for i, word in enumerate(b["word"].to_pylist()):
                own = {xxhash.xxh3_64_intdigest("|".join(k)) - (1 << 63) for k in edit_keys(word, order)}
                keys.extend(own)
                rows.extend([i] * len(own))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b["word"].take(at), b["n"].take(at)], ["key", "word", "n"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), a < b: all pairs of the words (word, n) that one inserted, deleted or replaced code point divides."""
    dealt = words.repartition(words.count() // WORDS_A_TASK + 1, "word")
    rows = stage(dealt.mapInArrow(_keyed(bigram_order(words)), "key long, word string, n long"), "edit-keys")
    a, b = (rows.select("key", F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)
    # Keys are hashes: what meets is compared as a whole.
    return a.join(b, "key").where(close).where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()


def forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n of each word: the most frequent near word, if it is ``factor`` times as frequent."""
    pairs = stage(near_pairs(words), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    takes = -F.col("best.less") >= factor * F.col("n")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of each word that has a form (word, form): the end of its chain.  Each round doubles the steps."""
    now = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now.sparkSession, now)
        now = step.select("word", "root")
        if not step.where("moved").take(1):
            return now


def spelling_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the words (word, n)."""
    words = stage(words, "vocabulary")
    found = stage(forms(words, factor), "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


# The checksum is the usual CRC-32 over bytes, by its table; near words share what is left when a letter goes.
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM r WHERE length(run) >= 7 GROUP BY id, run),
b AS (SELECT id, run, n, list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))) AS bytes FROM c),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda a, v: xor(a >> 8, crc[(xor(a, v) & 255) + 1])), 4294967295) AS h FROM b, t),
d AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
del AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
    SELECT x.word, y.word AS near, y.n AS near_n FROM del x JOIN del y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM del x JOIN w y ON x.rest = y.word
    UNION SELECT y.word, x.word, x.n FROM del x JOIN w y ON x.rest = y.word
),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, last) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.last AS root, f.n, f.n_near, f.form_n FROM f JOIN chain USING (word) JOIN f e ON e.word = chain.last WHERE e.form IS NULL
"""
