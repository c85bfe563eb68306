"""Documents laid out by release batch, and by id within: scans read the partitions and buckets that they need.

The table is partitioned by ``release_batch`` and bucketed and sorted by ``id``.  A
filter on the batch reads its partition; one on the id its bucket of each partition;
both, one file's worth.  A join with a small table of batches, or of the shards that
hold them, prunes partitions while it runs.  Documents without a batch are in the
partition of nulls.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.scans import SHARDS, shard_of


class DocumentTable:
    """Documents (id, size_bytes, extracted_text, release_batch) below a path."""

    COLUMNS = ("id STRING", "size_bytes BIGINT", "extracted_text STRING", "release_batch STRING")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"documents_{hashlib.sha256(self.path.encode()).hexdigest()[:32]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({', '.join(self.COLUMNS)}) USING parquet PARTITIONED BY (release_batch) "
            f"CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        self.buckets = buckets

    def append(self, docs: DataFrame) -> None:
        """Documents of whatever batches.  A large batch is dealt to as many tasks as there are buckets, not to one."""
        rows = docs.select("id", "size_bytes", "extracted_text", "release_batch")
        rows.repartition(self.buckets, "id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def document(self, doc_id: str, batch: str | None = None) -> DataFrame:
        """One document: of its bucket, in its batch's partition if that is given."""
        found = self.read().where(F.col("id") == doc_id)
        return found if batch is None else found.where(F.col("release_batch") == batch)

    def lookups(self, wanted: DataFrame) -> DataFrame:
        """The documents of ``wanted`` (id): bucket meets bucket, the table is not shuffled."""
        return self.read().hint("merge").join(wanted.select("id").distinct(), "id", "left_semi")

    def of_batches(self, batches: DataFrame) -> DataFrame:
        """The documents of some batches (release_batch), whose partitions alone are read."""
        return self.read().join(batches.where(F.col("release_batch").isNotNull()).distinct(), "release_batch", "left_semi")

    def of_shards(self, shards: DataFrame, table: dict[str, str] = SHARDS) -> DataFrame:
        """The documents of some shards (shard), with their shard: batches are looked up first, then their partitions are read."""
        batches = self.read().select("release_batch").distinct().withColumn("shard", shard_of(F.col("release_batch"), table))
        return self.read().join(batches.join(shards.distinct(), "shard"), "release_batch")
