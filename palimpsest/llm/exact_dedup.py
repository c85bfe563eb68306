"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to one
row per digest before anything is joined, the digests that the index lacks are
found with a sort-merge anti-join (the index side is read in its buckets,
without a shuffle) and appended under the batch's name.

The digests are appended before the batch's result is written.  A batch that is
run again under its name, after a failure at whatever point, does not meet its
own digests: its result is that of the first run, and nothing is appended twice.
Each append adds a file to every bucket; ``compact`` brings them back to one.
Batches are to follow each other; two at once may both keep a text.

Defined cases: a null text counts as empty; texts are equal when their UTF-8
bytes are (no normalisation); of equal texts in a batch the row with the largest
doc_id stays; a text that the index has from an earlier batch is not kept again,
and keep_id and group_size are those of that batch; rows that share doc_id and text share their verdict; a null doc_id is
below every other one, and where a group has only null ids none of its rows is
kept over another: keep_id is null and kept is true for all of them; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.names import free_names
from palimpsest.staging import new_path, stage

#: Buckets of a new index, unless the session shuffles to more partitions.
BUCKETS = 64
COLUMNS = ["digest", "keep_id", "group_size", "batch"]


class DigestIndex:
    """Digests seen so far: (digest, keep_id, group_size, batch), bucketed and sorted by digest.

    The folder holds a version of the table for each compaction; the number of buckets is part of a version's
    name, so that it stays with the data.  A version counts once a write to it has ended.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._versions()
        self.number, self.buckets = max(found) if found else (1, buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self._open()

    def _files(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[tuple[int, int]]:
        """(number, buckets) of the versions with data."""
        fs, p = self._files(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        parsed = [m for m in (re.fullmatch(r"v(\d+)-b(\d+)", n) for n in names) if m]
        done = [m for m in parsed if fs.exists(self._files(f"{self.path}/{m[0]}/_SUCCESS")[1])]
        return [(int(m[1]), int(m[2])) for m in done]

    def _open(self) -> None:
        """The table is named by its whole place, as folders of different indexes may end alike."""
        self.place = f"{self.path}/v{self.number:06d}-b{self.buckets}"
        self.table = f"digest_index_{hashlib.sha256(self.place.encode()).hexdigest()[:32]}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.place}'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Adds rows of ``COLUMNS``; all of them or, if it fails, none."""
        (
            rows.select(*COLUMNS).repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )

    def compact(self, buckets: int | None = None) -> None:
        """Rewrite the index with one file a bucket, and another number of buckets if given; nobody else may be reading it."""
        # As plain files: by the table's own buckets Spark would see no need to bring a bucket's files together.
        rows, old, table = self.spark.read.parquet(self.place).select(*COLUMNS), self.place, self.table
        self.number, self.buckets = self.number + 1, buckets or self.buckets
        self._open()
        self.append(rows)
        self.spark.sql(f"DROP TABLE {table}")
        fs, p = self._files(old)
        fs.delete(p, True)


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each whole text; the text itself goes no further."""
    return docs.select(F.col("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest"))


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Deduplicate ``docs`` against ``index`` and within itself, and append what is new.

    ``batch`` names the batch: to be given, and given again, where it may have to be run again.
    Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, seen_before.
    """
    name = F.lit(batch or uuid.uuid4().hex)
    rows = with_digest(docs)
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stage(groups, "digest-groups")
    earlier = index.read().where(F.col("batch") != name).select("digest", "keep_id", "group_size")
    fresh = groups.join(earlier.select("digest").hint("merge"), "digest", "left_anti")
    known = groups.select("digest").join(earlier.hint("merge"), "digest")
    decisions = stage(fresh.withColumn("seen_before", F.lit(False)).unionByName(known.withColumn("seen_before", F.lit(True))), "digest-decisions")
    new = decisions.where(~F.col("seen_before")).withColumn("batch", name)
    own = index.read().where(F.col("batch") == name)
    # Only a batch that is run again has rows there.
    index.append(new.join(own.select("digest").hint("merge"), "digest", "left_anti") if own.take(1) else new)
    # Both sides come straight from files, so that a digest that many rows share is split among tasks.
    kept = ~F.col("seen_before") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(decisions, "digest").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), "seen_before"
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_batch(docs, DigestIndex(spark, new_path(spark, "digest_index")))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256,
       false AS seen_before
FROM documents
"""


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay: of equal texts the row with the largest doc_id."""
    own, kept_id, digest = free_names(docs.columns, "digest", "kept_id", "kept_digest")
    verdicts = dedup_batch(docs, DigestIndex(spark, new_path(spark, "digest_index")))
    # A kept row is alone with its doc_id and text but for repeated rows, which go here.
    kept = verdicts.where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(digest)).distinct()
    rows = docs.withColumn(own, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    stays = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(digest)), "left_semi")
    return stays.dropDuplicates(["doc_id", own]).select(*docs.columns)
