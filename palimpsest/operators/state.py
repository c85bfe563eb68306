"""State tables: upserts, work queues, pending work, status and report figures.

Functions on tables return the next snapshot; nothing is updated in place.  Those on logs write the rows that change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import DEFAULTS, Settings
from palimpsest.functions.minhash import fingerprints
from palimpsest.sources.keyed_log import KeyedLog

STATUSES = ("pending", "running", "done", "failed")
SOFT_NOTE = "\n\n[SOFT_REDACTION_RECOVERED]\n"


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by id: new rows come in, known ones are refreshed unless their text or PDF has been processed.

    Progress flags are those of the old table, false for new documents.
    """
    flags = ["text_processed", "pdf_processed"]
    fields = [c for c in new.columns if c != "id" and c not in flags]
    o, n = old.alias("o"), new.select("id", *fields).alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    frozen = F.col("o.id").isNotNull() & (F.col("n.id").isNull() | F.col("o.text_processed") | F.col("o.pdf_processed"))
    return both.select(
        F.coalesce("o.id", "n.id").alias("id"),
        *[F.when(frozen, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in fields],
        *[F.coalesce(f"o.{c}", F.lit(False)).alias(c) for c in flags],
    )


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Results by group: the former count is kept, and output counts as generated only while the count stays."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.group_id") == F.col("n.group_id"), "full_outer")
    came, was = F.col("n.group_id").isNotNull(), F.col("o.group_id").isNotNull()
    take = lambda c: F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return j.select(
        F.coalesce("n.group_id", "o.group_id").alias("group_id"), take("merged_text"), take("recovered_count"),
        F.when(came & was, F.col("o.recovered_count")).when(came, F.lit(0)).otherwise(F.col("o.previous_recovered_count")).cast("bigint").alias("previous_recovered_count"),
        take("total_redacted"),
        F.when(~came, F.col("o.output_generated")).otherwise(F.coalesce(F.col("o.output_generated") & (F.col("o.recovered_count") == F.col("n.recovered_count")), F.lit(False))).alias("output_generated"),
        F.coalesce("n.output_path", "o.output_path").alias("output_path"),
    )


def insert_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verified pairs with their ids in string order; of a pair the row that was there first stays."""
    a, b = F.col("doc_id_a").cast("string"), F.col("doc_id_b").cast("string")
    rest = [c for c in old.columns if c not in ("doc_id_a", "doc_id_b")]
    tidy = lambda d, age: d.select(F.least(a, b).alias("doc_id_a"), F.greatest(a, b).alias("doc_id_b"), *rest, F.lit(age).alias("_age"))
    rows = tidy(old, 0).unionByName(tidy(new, 1)).where("doc_id_a != doc_id_b")
    w = Window.partitionBy("doc_id_a", "doc_id_b").orderBy("_age", *rest)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_age")


def append_soft_text(text: Column, soft: Column) -> Column:
    """A document's text with what was found under its masks; null stays null."""
    return F.concat(text, F.lit(SOFT_NOTE), soft)


def dequeue(jobs: DataFrame) -> DataFrame:
    """The next pending job of each stage: the highest priority, then the lowest id; as running."""
    w = Window.partitionBy("stage").orderBy(F.desc("priority"), "job_id")
    return jobs.where("status = 'pending'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("status", F.lit("running"))


def queue_stats(jobs: DataFrame) -> DataFrame:
    """(status, n) for every status, zero included."""
    all_of_them = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = jobs.groupBy("status").agg(F.count("*").alias("n"))
    return all_of_them.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def no_text(text: Column) -> Column:
    return text.isNull() | (text == "")


def status(docs: DataFrame) -> DataFrame:
    """One row of counts over all documents."""
    count = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    return docs.agg(
        F.count("*").alias("total"), count(F.col("text_processed"), "indexed"), count(F.col("pdf_processed"), "pdf_done"), count(F.col("pdf_url").isNotNull(), "pdf_total"),
        count(F.col("ocr_processed"), "ocr_done"), count(~F.col("ocr_processed") & no_text(F.col("extracted_text")), "ocr_pending"),
    )


def merge_stats(results: DataFrame) -> DataFrame:
    return results.agg(
        F.coalesce(F.sum(F.col("output_generated").cast("int")), F.lit(0)).alias("output_count"), F.coalesce(F.sum("recovered_count"), F.lit(0)).alias("recovered")
    )


def report_rates(results: DataFrame) -> DataFrame:
    """Groups with recoveries, spans recovered and masked, and their rate in per cent (N/A without spans)."""
    own = results.where("recovered_count > 0").agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("recovered_count"), F.lit(0)).alias("recovered"), F.coalesce(F.sum("total_redacted"), F.lit(0)).alias("redacted")
    )
    rate = F.when(F.col("redacted") > 0, F.concat(F.format_number(100.0 * F.col("recovered") / F.col("redacted"), 1), F.lit("%"))).otherwise("N/A")
    return own.withColumn("rate", rate)


def text_source_counts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text_source").isNotNull()).groupBy("text_source").agg(F.count("*").alias("n"))


def member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.count("*").alias("n"))


def groups_of_two(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with at least two members."""
    return groups.join(member_counts(members).where("n >= 2").select("group_id"), "group_id", "left_semi")


def unmerged(groups: DataFrame, members: DataFrame) -> DataFrame:
    return groups_of_two(groups.where("NOT merged"), members)


def stale_outputs(results: DataFrame) -> DataFrame:
    """(group_id, output_path) of outputs to remove: their group has no recovery any more."""
    return results.where("recovered_count = 0 AND (output_generated OR output_path IS NOT NULL)").select("group_id", "output_path")


def without_stale(results: DataFrame) -> DataFrame:
    """The results with stale outputs forgotten."""
    stale = F.expr("recovered_count = 0 AND (output_generated OR output_path IS NOT NULL)")
    return results.withColumns({"output_generated": F.when(stale, False).otherwise(F.col("output_generated")), "output_path": F.when(~stale, F.col("output_path"))})


def orphaned_files(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files (path) that no result with recoveries names."""
    valid = results.where("recovered_count > 0 AND output_path IS NOT NULL").select(F.col("output_path").alias("path"))
    return files.join(valid, "path", "left_anti")


def pending_output(results: DataFrame) -> DataFrame:
    return results.where("NOT output_generated AND recovered_count > 0").select("group_id")


def pending(docs: DataFrame, batches: list[str]) -> DataFrame:
    """(id, work) for each kind of work that a document waits for."""
    kinds = {
        "index": ~F.col("text_processed"),
        "pdf": ~F.col("pdf_processed") & F.col("pdf_url").isNotNull(),
        "ocr": ~F.col("ocr_processed") & no_text(F.col("extracted_text")),
        "backfill": F.col("text_processed") & no_text(F.col("extracted_text")) & F.col("text_source").isNull() & F.col("release_batch").isin(*batches),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda k: k.isNotNull())
    return docs.select("id", F.explode(found).alias("work"))


def new_batches(current: DataFrame, known: DataFrame) -> DataFrame:
    return current.select("release_batch").where("release_batch IS NOT NULL").distinct().join(known, "release_batch", "left_anti")


def in_order(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents by a list of ids (ids array<string>), with their place in it; unknown ids are left out."""
    wanted = ids.select(F.posexplode("ids").alias("pos", "id"))
    return wanted.join(docs, "id").select("pos", "id", "extracted_text")


def groups_to_remerge(members: DataFrame, changed: DataFrame) -> DataFrame:
    """Groups that a changed document (id) belongs to."""
    return members.join(changed.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("group_id").distinct()


def provenance_label(results: DataFrame, provenance: DataFrame) -> DataFrame:
    """Results (group_id, release_batch) with the label of the data set that VOL00008 or alike names."""
    number = F.regexp_extract("release_batch", r"^VOL0*([0-9]+)", 1)
    key = F.when(number != "", number.cast("long"))
    return results.withColumn("dataset", key).join(provenance, "dataset", "left")


def questionable(segments: DataFrame, settings: Settings = DEFAULTS, times: int = 3) -> DataFrame:
    """Segments with the confidence that their repetition in a group leaves."""
    n = F.count("*").over(Window.partitionBy("group_id", "text"))
    return segments.withColumn("confidence", F.when(n >= times, "questionable").otherwise("high"))


# --- logs: a batch writes what changes, and reads what was there before it -----------------------


def store_documents(log: KeyedLog, new: DataFrame, batch: int) -> None:
    """``upsert_documents`` on a log keyed by id: rows of documents that are new, or known and not processed."""
    flags = ("text_processed", "pdf_processed")
    old = log.latest(batch).select("id", (F.col(flags[0]) | F.col(flags[1])).alias("frozen"), F.lit(True).alias("known"))
    rows = old.hint("merge").join(new.drop(*flags), "id", "right").where("known IS NULL OR NOT frozen")
    log.write(rows.withColumns({f: F.lit(False) for f in flags}), batch)


def store_fingerprints(log: KeyedLog, new: DataFrame, batch: int) -> None:
    """The last fingerprint of a document counts; a row for each document."""
    log.write(new, batch)


def store_merge_results(log: KeyedLog, new: DataFrame, batch: int) -> None:
    """``upsert_merge_results`` on a log keyed by group_id."""
    old = log.latest(batch).select("group_id", F.lit(True).alias("known"), *(F.col(c).alias(f"old_{c}") for c in ("recovered_count", "output_generated", "output_path")))
    rows = old.hint("merge").join(new, "group_id", "right")
    same = F.col("old_output_generated") & (F.col("old_recovered_count") == F.col("recovered_count"))
    log.write(
        rows.select(
            "group_id", "merged_text", "recovered_count", F.when(F.col("known"), F.col("old_recovered_count")).otherwise(0).cast("bigint").alias("previous_recovered_count"),
            "total_redacted", F.coalesce(same, F.lit(False)).alias("output_generated"), F.coalesce("output_path", "old_output_path").alias("output_path"),
        ),
        batch,
    )


def store_provenance(log: KeyedLog, new: DataFrame, batch: int, at: Column | None = None) -> None:
    """Entries (dataset, entry: JSON) by data set, with the time of their arrival in them; the last one counts.

    ``at``: that time as text; the present time, if it is not given.
    """
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if at is None else at
    entry = F.coalesce(F.from_json("entry", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    stamped = F.map_concat(F.map_filter(entry, lambda k, v: k != "downloaded_at"), F.create_map(F.lit("downloaded_at"), stamp))
    log.write(new.select(F.col("dataset").cast("bigint").alias("dataset"), F.to_json(stamped).alias("entry")), batch)


def provenance_of(log: KeyedLog) -> DataFrame:
    """(dataset, entry map, downloaded_at) of all data sets."""
    entry = F.from_json("entry", "map<string,string>")
    return log.latest().select("dataset", entry.alias("entry"), entry["downloaded_at"].alias("downloaded_at"))


def soft_recovered(docs: DataFrame) -> DataFrame:
    """Documents to whose text something found under its masks was added; whatever its case."""
    return docs.where(F.lower("extracted_text").contains(SOFT_NOTE.strip().lower()))


def backfill_texts(docs: DataFrame, shards: DataFrame, layers: DataFrame, batches: list[str]) -> DataFrame:
    """The documents, with a text for those that wait for one: from a shard of their batch, else from their pages.

    ``shards`` and ``layers``: (id, extracted_text).  ``text_source`` says where a text came from: backfill, text_layer.
    Documents that have a text, or belong to none of ``batches``, stay as they are.
    """
    waits = no_text(F.col("extracted_text")) & F.col("text_processed") & F.col("text_source").isNull() & F.col("release_batch").isin(*batches)
    one = lambda rows, name: rows.where(~no_text(F.col("extracted_text"))).groupBy("id").agg(F.min("extracted_text").alias(name))
    due = docs.where(waits).select("id")
    found = due.join(one(shards, "shard_text"), "id", "left").join(one(layers, "layer_text"), "id", "left").where("shard_text IS NOT NULL OR layer_text IS NOT NULL")
    rows = docs.join(found, "id", "left")
    text = F.when(F.col("shard_text").isNotNull(), F.col("shard_text")).when(F.col("layer_text").isNotNull(), F.col("layer_text")).otherwise(F.col("extracted_text"))
    source = F.when(F.col("shard_text").isNotNull(), "backfill").when(F.col("layer_text").isNotNull(), "text_layer").otherwise(F.col("text_source"))
    return rows.withColumn("text_source", source).withColumn("extracted_text", text).select(*docs.columns)


def backfill_fingerprints(log: KeyedLog, docs: DataFrame, batch: int, settings: Settings = DEFAULTS) -> None:
    """New fingerprints of the documents whose text something was added to, and of no others; (id, sig, shingle_count) by id."""
    store_fingerprints(log, fingerprints(soft_recovered(docs), settings), batch)
