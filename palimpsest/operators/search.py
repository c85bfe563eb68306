"""Search for documents by words in their text, by person, dates, release batch and id, in any combination.

Substrings are looked up in a posting index: a log keyed by trigram, one row for
each document and trigram of its lower-case text.  A search takes the trigrams of
what is looked for that the fewest documents hold; as they are few and known when
the query is planned, Spark reads only their buckets, and of these only the row
groups that can hold them.  Documents that have all of them are candidates, whose
texts are verified.  Shorter strings than a trigram are looked for in all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.keyed_log import KeyedLog
from palimpsest.sources.scans import person as by_person

GRAM = 3
#: Trigrams of a search that are looked up.
LOOKED_UP = 4


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, by matches of no length: each place looks ahead, so time is linear."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))


#: Documents whose postings make one bucket; a bucket is sorted by one task.
BUCKET_DOCS = 2_000
#: With more partitions Spark sorts rows before it shuffles them, which took more memory (403 MB a task with 250 buckets on sf0.1) than it saved.
MOST_BUCKETS = 200


def buckets_for(docs: DataFrame) -> int:
    """So many buckets that one holds no more postings as documents become more, up to the most that need no sort."""
    return max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-docs.count() // BUCKET_DOCS)))


class TextIndex:
    """Postings (gram, id) of all documents, and how many documents hold each trigram."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.postings = KeyedLog(spark, f"{path.rstrip('/')}/postings", "gram STRING, id STRING", ["gram"], buckets)
        self.counts = KeyedLog(spark, f"{path.rstrip('/')}/counts", "gram STRING, n BIGINT", ["gram"], buckets)

    def add(self, docs: DataFrame, batch: int) -> None:
        """Documents (id, extracted_text) that come in; one that comes again, with another text, is found by both and verified."""
        rows = docs.where(F.col("extracted_text").isNotNull()).select("id", F.explode(trigrams(F.col("extracted_text"))).alias("gram"))
        self.postings.write(rows, batch)
        own = self.postings.rows().where(F.col("batch") == batch)
        self.counts.write(own.groupBy("gram").agg(F.count("*").alias("n")), batch)

    def candidates(self, word: str) -> DataFrame | None:
        """(id) of the documents that may hold a string; None if it is too short to tell."""
        low = word.lower()
        grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not grams:
            return None
        # At most as many rows as the string has trigrams.
        known = {r.gram: r.n for r in self.counts.rows().where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rare = sorted(grams, key=lambda g: (known.get(g, 0), g))[:LOOKED_UP]
        found = self.postings.rows().where(F.col("gram").isin(rare)).select("id", "gram").distinct()
        return found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("id")


def search(
    docs: DataFrame, word: str | None = None, batch: str | None = None, doc_id: str | None = None, dates: tuple[str, str] | None = None,
    person: str | None = None, emails: DataFrame | None = None, index: TextIndex | None = None,
) -> DataFrame:
    """The documents (id, release_batch, sent, extracted_text ...) that meet every condition given.

    ``word``: held by the text, whatever its case; ``dates``: first and last day of ``sent``; ``person``: among the
    participants of the document in ``emails`` (doc_id, all_participants).  Without ``index`` all texts are read.
    """
    found = docs
    if doc_id is not None:
        found = found.where(F.col("id") == doc_id)
    if batch is not None:
        found = found.where(F.col("release_batch") == batch)
    if dates is not None:
        found = found.where(F.col("sent").between(*(F.lit(x).cast("date") for x in dates)))
    if person is not None:
        found = found.join(by_person(emails, person).select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi")
    if word is not None:
        few = index.candidates(word) if index is not None else None
        if few is not None:
            found = found.join(few, "id", "left_semi")
        found = found.where(F.lower("extracted_text").contains(word.lower()))
    return found


def searches(docs: DataFrame, index: TextIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, id) of many searches for words at once: ``wanted`` (query_id, word) of three letters or more, by joins only.

    Each word looks up its rarest trigrams; postings of these alone are joined, and candidates verified.
    """
    grams = wanted.select("query_id", "word", F.explode(trigrams(F.col("word"))).alias("gram"))
    often = index.counts.rows().groupBy("gram").agg(F.sum("n").alias("n"))
    ranked = often.hint("merge").join(grams, "gram", "right").select("query_id", "word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    rare = ranked.groupBy("query_id", "word").agg(F.slice(F.array_sort(F.collect_list("g")), 1, LOOKED_UP).alias("rare"))
    keys = rare.select("query_id", "word", F.size("rare").alias("due"), F.explode("rare.gram").alias("gram"))
    held = index.postings.rows().select("gram", "id").hint("merge").join(keys, "gram").select("query_id", "word", "due", "id", "gram").distinct()
    few = held.groupBy("query_id", "word", "due", "id").agg(F.count("*").alias("n")).where("n = due").select("query_id", "word", "id")
    return few.join(docs.select("id", "extracted_text"), "id").where(F.lower("extracted_text").contains(F.lower("word"))).select("query_id", "id")
