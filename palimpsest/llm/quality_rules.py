r"""Quality rules with cross-document line frequencies, in DataFrame operations only.

Each document is one row of measures and, for the frequencies, one row for each
distinct normalised line (lower case, white space as single blanks) with its
hash and its number of words.  Per host (``source``) the documents that hold a
line are counted, exact copies of a document once.  A line is boilerplate of its
host by either of two measures: by count, in hosts of any size, or by its share
of the host's documents, which small hosts reach too.  Its words are taken off
the documents that hold it, and a document left with less than ``MIN_LEFT`` of
its words is depleted and rejected.

Words are maximal runs of characters other than blank, tab, newline, vertical
tab, form feed and return.  Windows of three words are compared by a 64-bit hash.

Defined cases: a null text has no words (and fails the base rules); a null
source is a host of its own; rows that share doc_id, source and text are one
document, and each gets its verdict; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.names import free_names
from palimpsest.staging import stage

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT = 50, 50
#: A line is boilerplate if more documents of its host hold it than MANY, or if FEW at least do and more than one in SHARE of them.
MANY, FEW, SHARE = 20, 5, 100
#: Words that must be left, as a percentage.
MIN_LEFT = 70

_GAP = r"[\\x20\\x09-\\x0D]+"


def _uid() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def normal_lines(text: Column) -> Column:
    """The lines of a text that hold a word: lower case, white space as single blanks."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))), lambda x: x != "")


def measures(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for each row."""
    rows = docs.select("doc_id", _uid().alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "uid",
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(f"filter(split(text, '{_GAP}'), w -> w != '')").alias("words"),
        F.expr(f"filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
    )
    rows = rows.select(
        "doc_id", "uid", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> xxhash64(w, element_at(words, i + 2), element_at(words, i + 3)))"
        ).alias("windows"),
        # The low bits that hold a window's place.
        F.expr("shiftleft(1L, cast(ceil(log2(size(words) + 1.0)) as int)) - 1").alias("low"),
    )
    # Sorted by hash, equal windows are neighbours; the places come along in the low bits, and the whole hashes are compared.
    rows = rows.withColumn("sorted", F.expr("sort_array(transform(windows, (h, i) -> (h & ~low) | i))"))
    same = "((x ^ {0}) & ~low) = 0 AND element_at(windows, cast(x & low as int) + 1) = element_at(windows, cast({0} & low as int) + 1)"
    before, after = "element_at(sorted, j)", "element_at(sorted, j + 2)"
    found = (
        f"sort_array(transform(filter(sorted, (x, j) -> (j > 0 AND {same.format(before)}) "
        f"OR (j + 1 < size(sorted) AND {same.format(after)})), x -> x & low))"
    )
    rows = rows.withColumn("places", F.expr(found))
    # Each repeated window covers three words, but for those that the one before covers.
    covered = "aggregate(transform(places, (p, i) -> if(i = 0, 3L, least(3L, p - element_at(places, i)))), 0L, (a, b) -> a + b)"
    return rows.select("uid", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def boilerplate(docs: DataFrame, many: int = MANY, few: int = FEW, share: int = SHARE) -> DataFrame:
    """(line_key): hashes of host and normalised line of the lines above the limits, written to the shared folder."""
    rows = docs.where(F.col("text").isNotNull()).select(
        F.xxhash64("source").alias("host"), F.xxhash64("text").alias("text_hash"), F.explode(F.array_distinct(normal_lines(F.col("text")))).alias("line")
    )
    rows = rows.select("host", "text_hash", F.xxhash64("host", "line").alias("line_key"))
    # Copies of a document count once: first one row for each (host, line, text), then a count for each (host, line).
    lines = rows.distinct().groupBy("host", "line_key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min(few, many + 1))
    hosts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("source").alias("host"), F.xxhash64("text").alias("text_hash"))
    hosts = hosts.distinct().groupBy("host").agg(F.count("*").alias("n_all"))
    by_share = (F.col("n_docs") >= few) & (F.col("n_docs") * share > F.col("n_all"))
    return stage(lines.join(hosts, "host").where((F.col("n_docs") > many) | by_share).select("line_key"), "boilerplate")


def removed_lines(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """(uid, removed_words, line_keys) of documents that hold boilerplate: its words, and the lines."""
    rows = docs.where(F.col("text").isNotNull()).select(
        _uid().alias("uid"), F.xxhash64("source").alias("host"), F.posexplode(normal_lines(F.col("text"))).alias("place", "line")
    )
    rows = rows.select("uid", "place", F.xxhash64("host", "line").alias("line_key"), F.size(F.split("line", " ")).cast("long").alias("words"))
    # ``bad`` is a written table: Spark knows its size, and broadcasts it only below the session's threshold.
    # Of rows that repeat a document, each line counts once: sets stay as large as one of them, however many there are.
    found = rows.join(bad, "line_key").groupBy("uid").agg(F.collect_set(F.struct("place", "line_key", "words")).alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select("uid", total.alias("removed_words"), F.array_distinct(F.transform("lines", lambda x: x["line_key"])).alias("line_keys"))


def judge(docs: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """One row for each row: uid, doc_id, the measures, removed_words, base_failed, kept, line_keys (lines to remove)."""
    bad = boilerplate(docs) if bad is None else bad
    # Written first: Spark would push a caller's filter on ``kept`` into the measures, and sort each text's windows once for each window.
    rows = stage(measures(docs), "measures").join(removed_lines(docs, bad), "uid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < MIN_LEFT * F.col("n_words")
    return rows.select(
        "uid", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "line_keys",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).drop("uid", "line_keys")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, in the columns of ``docs``, without their lines above the limits."""
    uid, own_id, own_uid, line_keys = free_names(docs.columns, "uid", "kept_id", "kept_uid", "line_keys")
    kept = judge(docs).where("kept").select(F.col("doc_id").alias(own_id), F.col("uid").alias(own_uid), F.col("line_keys").alias(line_keys)).dropDuplicates([own_id, own_uid])
    rows = docs.withColumn(uid, _uid()).join(kept, (F.col(uid) == F.col(own_uid)) & F.col("doc_id").eqNullSafe(F.col(own_id)))
    left = F.array_join(
        F.filter(
            F.split("text", "\n"),
            lambda x: ~F.array_contains(line_keys, F.xxhash64(F.xxhash64("source"), F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))))),
        ),
        "\n",
    )
    text = F.when(F.col(line_keys).isNull(), F.col("text")).otherwise(left)
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs)


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (
    SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d
),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
win AS (
    SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)
),
rep AS (SELECT rid, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS hit FROM win),
cov AS (
    SELECT rid, hit OR coalesce(lag(hit, 1) OVER o, false) OR coalesce(lag(hit, 2) OVER o, false) AS c
    FROM rep WINDOW o AS (PARTITION BY rid ORDER BY i)
),
nrep AS (SELECT rid, count(*) FILTER (WHERE c) AS n_repeat_words FROM cov GROUP BY rid),
lines AS (
    SELECT d.rid, d.source, d.text, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
    FROM d JOIN (SELECT rid, unnest(ls) AS l FROM w) USING (rid)
),
freq AS (SELECT source, line, count(DISTINCT text) AS n_docs FROM lines GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS n_all FROM documents WHERE text IS NOT NULL GROUP BY source),
bad AS (SELECT source, line FROM freq JOIN hosts USING (source) WHERE n_docs > 20 OR (n_docs >= 5 AND n_docs * 100 > n_all)),
gone AS (SELECT rid, sum(len(string_split(line, ' '))) AS removed FROM lines JOIN bad USING (source, line) GROUP BY rid),
m AS (
    SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
           coalesce(removed, 0)::BIGINT AS removed_words
    FROM d JOIN w USING (rid) LEFT JOIN nrep USING (rid) LEFT JOIN gone USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= 70 * n_words AS kept
FROM m
"""
