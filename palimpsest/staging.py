"""Tables written to the folder the whole cluster shares, to cut lineage.

A staged table survives the loss of any executor and is computed once, however
many plans read it.  The folder is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine.
LOCAL_DEFAULT = "/tmp/checkpoints"
#: What a task gets in ``small_tasks``: bytes of files, which can be a tenth of what rows with names take in memory; bytes of a shuffle; rows of one.
FILE_BYTES, SHUFFLE_BYTES, TASK_ROWS = 8 << 20, 16 << 20, 500_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DEFAULT


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of staged tables whose readers have all been written."""
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for frame in frames for f in frame.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_tasks(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """What is run within has tasks of a bounded size, and more of them the more there is; ``rows``: about what goes through a shuffle.

    A task that sorts or hashes its part of a table takes memory in proportion to it, and Spark's own bound is 128 MB of compressed files.
    Values of the session that are stricter stay as they are, and all are put back.
    """
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    files, shuffled, partitions = before.values()
    now = (min(size(files), FILE_BYTES), min(size(shuffled), SHUFFLE_BYTES), max(int(partitions), -(-rows // TASK_ROWS)))
    try:
        for k, v in zip(before, now):
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
