r"""Benchmark decontamination, in DataFrame operations only.

The windows of all items are sets of shingles to be contained whole.  A window
occurs only where all of its shingles do, so it is enough to join one of them,
the prefix that a set join at full containment needs: the shingle that the
documents hold least often.  Where it is found, the window's start follows from
the places of both (not before the text, not beyond its length), and the window
is verified: the shingles that cover it have to stand where they belong.

Documents are read in one pass to the places where they hold a shingle of the
benchmark at all, and these are written; everything after that is as large as
what the two have in common.  Shingles meet by hash and are compared as text
after that.  The benchmark's shingles are a written table: Spark sends it to all
tasks only where its size is below the session's limit, and sorts and merges
otherwise.  What a text or passage is shared by a third of all rows is joined
with small tables only, or split by Spark's handling of skewed joins.

Words are maximal runs of a-z, 0-9 and all beyond ASCII, after A-Z are lowered.
A document is known by a digest of doc_id and text.

Defined cases: a null or empty text has no words, as a document and as an item;
an item of fewer words than a window is one window; repeated rows of documents
get the same result each, repeated items count once; a null item_id is an empty
string; a null doc_id is passed on; empty tables give an empty result, or no
hits; texts of any length are read whole; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.staging import stage

WINDOW, SHINGLE = 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _OTHER), "")


def uid() -> Column:
    """The digest that a document is known by."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))))


def _runs(rows: DataFrame, n: int, *kept: str) -> DataFrame:
    """The kept columns, pos and w1 to wn: of each place in ``words`` the n words that start there, null beyond the end."""
    # Shifted copies side by side: neither lambda functions nor a copy of the array for each place.
    shifted = F.arrays_zip(F.col("words"), *(F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"s{i}") for i in range(1, n)))
    rows = rows.select(*kept, F.posexplode(shifted).alias("pos", "w"))
    return rows.select(*kept, "pos", *(F.col(f"w.{'words' if i == 0 else f's{i}'}").alias(f"w{i + 1}") for i in range(n)))


def _key(k: int, first: int = 1) -> Column:
    return F.xxhash64(F.lit(k), *(F.col(f"w{i}") for i in range(first, first + k)))


def _text(k: int, first: int = 1) -> Column:
    return F.concat_ws(" ", *(F.col(f"w{i}") for i in range(first, first + k)))


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """(item_id string, window, m, w1 ...): the windows of all items, and their numbers of words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words"))
    rows = _runs(items.withColumn("m", F.least(F.size("words"), F.lit(length))), length, "item_id", "m")
    whole = F.col(f"w{length}").isNotNull() | ((F.col("m") < length) & (F.col("pos") == 0))
    return rows.where(whole).select("item_id", _text(length).alias("window"), "m", *(f"w{i}" for i in range(1, length + 1)))


def pieces(found: DataFrame, length: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(window, m, k, off, key, shingle): of each distinct window all its shingles, one of k words where it is shorter."""
    distinct = found.drop("item_id").distinct()
    own = [
        F.when(F.col("m") >= i + shingle, F.struct(F.lit(shingle).alias("k"), F.lit(i).alias("off"), _key(shingle, i + 1).alias("key"), _text(shingle, i + 1).alias("shingle")))
        for i in range(length - shingle + 1)
    ]
    own += [F.when(F.col("m") == k, F.struct(F.lit(k).alias("k"), F.lit(0).alias("off"), _key(k).alias("key"), _text(k).alias("shingle"))) for k in range(1, min(shingle, length + 1))]
    return distinct.select("window", "m", F.explode(F.array(*own)).alias("p")).where("p IS NOT NULL").select("window", "m", "p.*")


def shared_shingles(docs: DataFrame, parts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(uid, n_words, pos, shingle): the places of documents (uid, words) that hold a shingle of the benchmark."""
    sizes = sorted(r.k for r in parts.select("k").distinct().collect())  # as many as a shingle has words, at most
    keys = stage(parts.select("key", "k").distinct(), "shingle-keys")
    rows = _runs(docs.select("uid", F.size("words").alias("n_words"), "words"), shingle, "uid", "n_words")
    if len(sizes) == 1:
        rows = rows.where(F.col(f"w{sizes[0]}").isNotNull()).withColumn("key", _key(sizes[0]))
    elif sizes:
        rows = rows.withColumn("key", F.explode(F.array(*(F.when(F.col(f"w{k}").isNotNull(), _key(k)) for k in sizes)))).where("key IS NOT NULL")
    else:
        rows = rows.withColumn("key", F.lit(0).cast("long"))
    text = F.coalesce(*(F.when(F.col("k") == k, _text(k)) for k in range(1, shingle + 1)))
    return stage(rows.join(keys, "key").select("uid", "n_words", "pos", text.alias("shingle")), "shared-shingles")


def occurrences(docs: DataFrame, found: DataFrame, length: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(uid, start, m, window): each place of the documents (uid, words) where one of the windows stands, in words from 0."""
    parts = stage(pieces(found, length, shingle), "window-shingles")
    hits = shared_shingles(docs, parts, shingle)
    often = hits.groupBy("shingle").agg(F.count("*").alias("n"))
    rarest = parts.join(often, "shingle").groupBy("window", "m", "k").agg(F.min(F.struct("n", "shingle", "off")).alias("rarest"), F.count("*").alias("n_found"))
    # A window with a shingle that no document holds occurs nowhere.
    prefix = stage(rarest.where("n_found = m - k + 1").select("window", "m", "k", "rarest.shingle", "rarest.off"), "prefixes")
    at = hits.join(prefix, "shingle").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 AND start + m <= n_words")
    covering = stage(parts.where("off IN (0, m - k)").select("window", "off", "shingle"), "covering")
    due = at.select("uid", "start", "window", "m", "k").join(covering, "window").select("uid", "start", "window", "m", "k", "off", "shingle", (F.col("start") + F.col("off")).alias("pos"))
    # Repeated rows of a document meet each other here: the first and the last shingle have to be there, however often.
    met = due.join(hits.select("uid", "pos", "shingle"), ["uid", "pos", "shingle"]).groupBy("uid", "start", "window", "m", "k").agg(F.min("off").alias("low"), F.max("off").alias("high"))
    return met.where("low = 0 AND high = m - k").select("uid", "start", "m", "window")


def hit_spans(places: DataFrame) -> DataFrame:
    """(uid, start, n_new): the distinct starts of occurrences, and how many words of each no earlier one covers."""
    longest = places.groupBy("uid", "start").agg(F.max("m").alias("m"))
    before = Window.partitionBy("uid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("m")
    reached = F.greatest("start", F.coalesce(F.max(end).over(before), F.col("start")))
    return longest.select("uid", "start", F.greatest(end - reached, F.lit(0)).alias("n_new"))


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings) for each row of the documents."""
    found = stage(windows(benchmark, length), "windows")
    rows = docs.select("doc_id", uid().alias("uid"), words(F.col("text")).alias("words"))
    places = stage(occurrences(rows, found, length, shingle), "occurrences")
    hit = hit_spans(places).groupBy("uid").agg(F.sum("n_new").alias("n_hit"))
    held = places.select("uid", "window").distinct().join(found.select("window", "item_id").distinct(), "window").select("uid", "item_id").distinct()
    items = held.groupBy("uid").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    both = stage(hit.join(items, "uid"), "contaminated")
    result = rows.select("doc_id", "uid", F.size("words").cast("long").alias("n_words")).join(both, "uid", "left")
    return result.select("doc_id", "n_words", F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (SELECT item_id, least(len(ws), 10) AS m, array_to_string(ws[p:p + 9], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT m FROM i),
s AS (SELECT rid, m, p, array_to_string(ws[p:p + m - 1], ' ') AS win FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, n WHERE len(ws) >= m)),
o AS (SELECT rid, s.m, p, item_id FROM s JOIN i ON s.m = i.m AND s.win = i.win),
h AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS w FROM o) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM o) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
