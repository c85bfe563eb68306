"""Scans of documents, their texts and binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shard that holds a release batch's texts.
SHARDS = {
    "VOL00008": "VOL00008",
    "VOL00008-2": "VOL00008",
    "VOL00008-OFFICIAL-DOJ-LATEST": "VOL00008",
    "VOL00009": "VOL00009",
    "VOL00010": "VOL00010",
    "DataSet11": "DataSet11",
}
OTHER_SHARD = "other"
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"


def shard_of(batch: Column, shards: dict[str, str] = SHARDS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])
    return F.coalesce(table[batch], F.lit(OTHER_SHARD))


def release_batches(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("release_batch").isNotNull()).select("release_batch").distinct()


def metadata(docs: DataFrame, batch: str | None = None) -> DataFrame:
    """Documents without their texts, of one release batch or all."""
    kept = docs.select("id", "release_batch", "size_bytes")
    return kept if batch is None else kept.where(F.col("release_batch") == batch)


def document(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.where(F.col("id") == doc_id).select("id", "extracted_text")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the documents in ``ids`` (id)."""
    return docs.select("id", "extracted_text").join(ids, "id", "left_semi")


def keyword(docs: DataFrame, word: str, column: str = "description") -> DataFrame:
    return docs.where(F.lower(column).contains(word.lower()))


def person(emails: DataFrame, name: str) -> DataFrame:
    """Documents (doc_id) whose participants (all_participants) include a name, whatever its case."""
    return emails.where(F.col("doc_id").isNotNull() & F.lower("all_participants").contains(name.lower())).select("doc_id").distinct()


def with_texts(meta: DataFrame, texts: DataFrame) -> DataFrame:
    """Metadata with texts, empty where there is none."""
    return meta.join(texts.select("id", "extracted_text"), "id", "left").withColumn("extracted_text", F.coalesce("extracted_text", F.lit("")))


def page_class(pixels: Column) -> Column:
    """What a page shows, from its gray values: the first of redacted, photo, blank that holds, else text."""
    n = F.size(pixels)
    share = lambda test: F.size(F.filter(pixels, test)) / n
    return (
        F.when(share(lambda p: p < 25) > 0.90, "redacted")
        .when(share(lambda p: (p >= 25) & (p <= 230)) > 0.40, "photo")
        .when(share(lambda p: p > 230) > 0.98, "blank")
        .otherwise("text")
    )


def text_layer(pages: DataFrame, min_words: int = 50) -> DataFrame:
    """(id, extracted_text) of documents from their pages (id, page, text) with enough words a page on average."""
    n_words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = pages.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_words", n_words)
    docs = rows.groupBy("id").agg(F.avg("n_words").alias("mean"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return docs.where(F.col("mean") >= min_words).select("id", F.array_join(F.transform("pages", lambda p: p["text"]), PAGE_BREAK).alias("extracted_text"))


def soft_redactions(drawings: DataFrame) -> DataFrame:
    """(id, page, rect, text) of texts under black fills (id, page, fill array, rect array, text) of at least 5 by 5 points."""
    black = F.col("fill") == F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    wide = (F.col("rect")[2] - F.col("rect")[0] >= 5) & (F.col("rect")[3] - F.col("rect")[1] >= 5)
    return drawings.where(black & wide).select("id", "page", "rect", F.trim("text").alias("text")).where("text != ''")


def binary_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str] | None], glob: str = "*.pdf") -> DataFrame:
    """(path, page, text) of the files below a path, by a function from a file's bytes to its pages' texts (None: unreadable)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, k, t) for p, c in zip(b["path"].to_pylist(), b["content"]) for k, t in enumerate(extract(c.as_py()) or [])]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["path", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, page bigint, text string")


def checked_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(name, sha256, expected, matches) of files against ``expected`` (name, sha256)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return files.join(expected.withColumnRenamed("sha256", "expected"), "name", "left").withColumn("matches", F.col("sha256") == F.col("expected"))
