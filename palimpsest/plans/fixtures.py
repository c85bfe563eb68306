"""Inputs with masks, headers and state, derived from the generated tables by rules that SQL shares."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.minhash import in_slices
from palimpsest.tables import read, spread

#: Every so many words one is masked, at one place in version A and at another in B.
EVERY, PLACE_A, PLACE_B = 151, 3, 79


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("release_batch"), F.col("n_chars").alias("size_bytes"), F.col("text").alias("extracted_text")
    )


DOCUMENTS_SQL = "d0 AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS release_batch, n_chars AS size_bytes, text AS extracted_text FROM documents)"


def versions(spark: SparkSession, sf_dir: str, every: int = EVERY, a: int = PLACE_A, b: int = PLACE_B) -> DataFrame:
    """Two versions (id, doc_id, extracted_text) of every document, each with masks of its own; one without a place for its mask has none."""
    masks = ((0, a, "[REDACTED]"), (1, b, "[b(6)]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            own = [(k, None if t is None else _BLANKS.sub(" ", t).strip(" ").split(" ")) for k, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
            rows = [(None if k is None else str(2 * k + v), k, _masked(words, every, at, by)) for k, words in own for v, at, by in masks]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["id", "doc_id", "extracted_text"])

    docs = spread(read(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "id string, doc_id bigint, extracted_text string")


def version_pairs(spark: SparkSession, sf_dir: str, every: int = EVERY, a: int = PLACE_A, b: int = PLACE_B) -> DataFrame:
    """Both versions of each document in one row: (doc_id, id_a, text_a, id_b, text_b), each with masks of its own; one without a place for its mask has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            words = [None if t is None else _BLANKS.sub(" ", t).strip(" ").split(" ") for t in texts]
            columns = [pa.array(ids, pa.int64())]
            for v, at, by in ((0, a, "[REDACTED]"), (1, b, "[b(6)]")):
                columns += [pa.array([None if k is None else str(2 * k + v) for k in ids], pa.string()), pa.array([_masked(w, every, at, by) for w in words], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id_a", "text_a", "id_b", "text_b"])

    docs = spread(read(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, id_a string, text_a string, id_b string, text_b string")


#: White space, as Unicode has it and ``text.collapse`` takes it.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _masked(words: list[str] | None, every: int, at: int, by: str) -> str | None:
    if words is None:
        return None
    own = list(words)
    own[at::every] = [by] * len(range(at, len(own), every))
    return " ".join(own)


VERSIONS_SQL = rf"""
vw AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS words FROM documents),
v AS (
    SELECT CAST(doc_id * 2 AS VARCHAR) AS id, doc_id,
           array_to_string(list_transform(words, lambda w, i: CASE WHEN (i - 1) % {EVERY} = {PLACE_A} THEN '[REDACTED]' ELSE w END), ' ') AS extracted_text
    FROM vw
    UNION ALL
    SELECT CAST(doc_id * 2 + 1 AS VARCHAR), doc_id,
           array_to_string(list_transform(words, lambda w, i: CASE WHEN (i - 1) % {EVERY} = {PLACE_B} THEN '[b(6)]' ELSE w END), ' ')
    FROM vw
),
rp AS (SELECT min(id) AS id, extracted_text FROM v WHERE extracted_text IS NOT NULL GROUP BY extracted_text)"""


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails (id, extracted_text) from orders and customers."""
    o = spread(read(spark, sf_dir, "orders")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(
        F.lit("From: "), "c_name", F.lit("\nTo: "), "o_orderpriority", F.lit("\nDate: "), F.col("o_orderdate").cast("date").cast("string"),
        F.lit("\nSubject: Order "), (F.col("o_orderkey") % 400).cast("string"), F.lit("\n\nbody of "), F.col("o_orderkey").cast("string"),
    )
    return o.select(F.col("o_orderkey").cast("string").alias("id"), text.alias("extracted_text"))


EMAILS_SQL = """
e AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS id,
           'From: ' || c_name || chr(10) || 'To: ' || o_orderpriority || chr(10) || 'Date: ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || chr(10)
           || 'Subject: Order ' || CAST(o_orderkey % 400 AS VARCHAR) || chr(10) || chr(10) || 'body of ' || CAST(o_orderkey AS VARCHAR) AS extracted_text
    FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with flags of progress."""
    k = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        k.cast("string").alias("id"), F.col("source").alias("release_batch"), F.when(k % 5 == 0, "").when(k % 7 == 0, None).otherwise(F.col("text")).alias("extracted_text"),
        (k % 2 == 0).alias("text_processed"), (k % 3 == 0).alias("pdf_processed"), (k % 11 == 0).alias("ocr_processed"),
        F.when(k % 4 != 0, F.concat(F.lit("u/"), k.cast("string"))).alias("pdf_url"), F.when(k % 6 == 0, "ocr").when(k % 6 == 1, "layer").alias("text_source"),
    )


STATE_SQL = """
st AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, source AS release_batch, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS extracted_text,
           doc_id % 2 = 0 AS text_processed, doc_id % 3 = 0 AS pdf_processed, doc_id % 11 = 0 AS ocr_processed,
           CASE WHEN doc_id % 4 <> 0 THEN 'u/' || CAST(doc_id AS VARCHAR) END AS pdf_url, CASE WHEN doc_id % 6 = 0 THEN 'ocr' WHEN doc_id % 6 = 1 THEN 'layer' END AS text_source
    FROM documents
)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in groups by supplier-like keys: (group_id, doc_id)."""
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).cast("string").alias("group_id"), F.col("o_orderkey").cast("string").alias("doc_id"))


MEMBERS_SQL = "mb AS (SELECT CAST(o_custkey % 97 AS VARCHAR) AS group_id, CAST(o_orderkey AS VARCHAR) AS doc_id FROM orders)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("stage"), (F.floor("value").cast("int") % 3).alias("priority"),
        F.when(F.col("event_id") % 4 == 0, "done").when(F.col("event_id") % 4 == 1, "failed").otherwise("pending").alias("status"),
    )


JOBS_SQL = """
jb AS (
    SELECT event_id AS job_id, event_type AS stage, CAST(floor(value) AS INTEGER) % 3 AS priority,
           CASE WHEN event_id % 4 = 0 THEN 'done' WHEN event_id % 4 = 1 THEN 'failed' ELSE 'pending' END AS status
    FROM events
)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge results by customer, with some that have lost their recoveries."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("group_id"), F.col("c_name").alias("merged_text"), (k % 4).cast("bigint").alias("recovered_count"), (k % 2).cast("bigint").alias("previous_recovered_count"),
        (k % 9).cast("bigint").alias("total_redacted"), (k % 3 == 0).alias("output_generated"), F.when(k % 5 == 0, F.concat(F.lit("out/"), k.cast("string"))).alias("output_path"),
    )


RESULTS_SQL = """
rs AS (
    SELECT c_custkey AS group_id, c_name AS merged_text, CAST(c_custkey % 4 AS BIGINT) AS recovered_count, CAST(c_custkey % 2 AS BIGINT) AS previous_recovered_count,
           CAST(c_custkey % 9 AS BIGINT) AS total_redacted, c_custkey % 3 = 0 AS output_generated, CASE WHEN c_custkey % 5 = 0 THEN 'out/' || CAST(c_custkey AS VARCHAR) END AS output_path
    FROM customer
)"""
