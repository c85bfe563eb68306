"""Queries for what grows by batches: capped groups, logs, the band index, the incremental cycle; and for JSON and backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.config import DEFAULTS
from palimpsest.functions import minhash, payload
from palimpsest.operators import capped, state
from palimpsest.operators.band_index import BandIndex
from palimpsest.plans import fixtures as fx
from palimpsest.plans.queries import CANDIDATES, SQL, VERIFIED, _representatives, query
from palimpsest.sources import scans
from palimpsest.sources.keyed_log import KeyedLog
from palimpsest.staging import new_path, small_tasks, stage
from palimpsest.streaming.ingest import Reconciler
from palimpsest.tables import read

# --- capped groups -----------------------------------------------------------------------------

CHAIN_SQL = "ch AS (SELECT CAST(o_orderkey AS VARCHAR) AS x, CAST(o_orderkey + 1 AS VARCHAR) AS y FROM orders WHERE o_orderkey % 7 <> 0)"


@query(f"""WITH RECURSIVE {CHAIN_SQL}, ed AS (SELECT x, y FROM ch UNION SELECT y, x FROM ch),
r(x, y) AS (SELECT x, x FROM ed UNION SELECT r.x, ed.y FROM r JOIN ed ON ed.x = r.y) SELECT x AS doc_id, min(y) AS group_id FROM r GROUP BY x""")
def capped_groups(spark, d):
    k = F.col("o_orderkey")
    edges = read(spark, d, "orders").where("o_orderkey % 7 != 0").select(k.cast("string").alias("doc_id_a"), (k + 1).cast("string").alias("doc_id_b"))
    return capped.capped_groups(edges, DEFAULTS.group_cap)[0]


#: A cap that suppliers with their orders exceed many times.
SMALL_CAP = 50


@query(f"""WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 's' || l_suppkey AS b FROM lineitem WHERE l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL)
SELECT (SELECT count(*) FROM (SELECT a FROM e UNION SELECT b FROM e)) AS n_docs, count(*) AS n_edges, 0 AS n_above, 0 AS n_unexplained, 0 AS n_unaccounted, count(*) > {SMALL_CAP} AS refuses FROM e""")
def capped_account(spark, d):
    """Orders and suppliers in groups under a small cap: no group above what the cap allows, each edge inside a group or refused by a full one."""
    edges = read(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("doc_id_a"), F.concat(F.lit("s"), "l_suppkey").alias("doc_id_b"))
    members, refused = capped.capped_groups(edges, SMALL_CAP)
    with small_tasks(spark):
        edges = stage(edges.where("doc_id_a IS NOT NULL AND doc_id_b IS NOT NULL").distinct(), "all-edges")
    with small_tasks(spark, edges.count()):
        return stage(_account(edges, members, refused), "account")


def _account(all_edges, members, refused):
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
    own = lambda x: members.join(sizes, "group_id").select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("group_id").alias(f"group_{x}"), F.col("n").alias(f"n_{x}"))
    sided = lambda rows: rows.join(own("a"), "doc_id_a", "left").join(own("b"), "doc_id_b", "left")
    full = F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))) >= SMALL_CAP
    across = ~F.coalesce(F.col("group_a") == F.col("group_b"), F.lit(False))
    counts = sided(all_edges).agg(F.count("*").alias("n_edges"), F.coalesce(F.sum(across.cast("int")), F.lit(0)).alias("n_across"))
    refusals = sided(refused).agg(F.count("*").alias("n_refused"), F.coalesce(F.sum((~full).cast("int")), F.lit(0)).cast("int").alias("n_unexplained"))
    above = sizes.agg(F.coalesce(F.sum((F.col("n") > 2 * SMALL_CAP - 2).cast("int")), F.lit(0)).cast("int").alias("n_above"))
    docs = all_edges.select("doc_id_a").union(all_edges.select("doc_id_b")).distinct().agg(F.count("*").alias("n_docs"))
    one = counts.join(refusals).join(above).join(docs)  # four tables of one row
    return one.select("n_docs", "n_edges", "n_above", "n_unexplained", (F.col("n_across") - F.col("n_refused")).cast("int").alias("n_unaccounted"), (F.col("n_refused") > 0).alias("refuses"))


# --- logs --------------------------------------------------------------------------------------


def _log(spark, name: str, schema: str, *key: str) -> KeyedLog:
    return KeyedLog(spark, new_path(spark, name), schema, list(key))


@query(SQL["upsert_documents"])
def stored_documents(spark, d):
    old = fx.state(spark, d).select("id", "release_batch", "extracted_text", "text_processed", "pdf_processed")
    new = old.where("release_batch != 'src1'").select("id", F.concat("release_batch", F.lit("-new")).alias("release_batch"), F.lit("fresh").alias("extracted_text"))
    new = new.unionByName(old.where("release_batch = 'src2'").select(F.concat(F.lit("x"), "id").alias("id"), "release_batch", "extracted_text"))
    log = _log(spark, "stored-documents", "id STRING, release_batch STRING, extracted_text STRING, text_processed BOOLEAN, pdf_processed BOOLEAN", "id")
    log.write(old, 0)
    state.store_documents(log, new, 1)
    return log.latest().select("id", "release_batch", F.md5(F.coalesce("extracted_text", F.lit("?"))).alias("text_md5"), "text_processed", "pdf_processed")


@query("""SELECT user_id AS doc_id, event_id AS seq, value FROM events WHERE user_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) = 1""")
def stored_fingerprints(spark, d):
    rows = read(spark, d, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "value")
    log = _log(spark, "stored-fingerprints", "doc_id BIGINT, seq BIGINT, value DOUBLE", "doc_id")
    for batch in (0, 1):
        state.store_fingerprints(log, state.latest(rows.where(F.col("seq") % 2 == batch), ["doc_id"], "seq"), batch)
    return log.latest().drop("batch")


@query(SQL["upsert_merge_result"])
def stored_merge_results(spark, d):
    old, k = fx.results(spark, d), F.col("group_id")
    new = old.select((k + 5).alias("group_id"), F.lit("new").alias("merged_text"), (k % 3).cast("bigint").alias("recovered_count"), F.lit(7).cast("bigint").alias("total_redacted"),
                     F.when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("output_path"))
    schema = "group_id BIGINT, merged_text STRING, recovered_count BIGINT, previous_recovered_count BIGINT, total_redacted BIGINT, output_generated BOOLEAN, output_path STRING"
    log = _log(spark, "stored-results", schema, "group_id")
    log.write(old, 0)
    state.store_merge_results(log, new, 1)
    return log.latest().drop("batch")


@query("""SELECT c_custkey AS dataset, CASE WHEN c_custkey % 3 = 0 THEN 'again ' || c_name ELSE c_name END AS label, CASE WHEN c_custkey % 3 = 0 THEN '2024-05-02' ELSE '2024-05-01' END AS downloaded_at,
CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer""")
def stored_provenance(spark, d):
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    log = _log(spark, "stored-provenance", "dataset BIGINT, entry STRING", "dataset")
    first = F.to_json(F.struct(F.col("c_name").alias("label"), F.col("c_nationkey").alias("nation"), F.lit("never").alias("downloaded_at")))
    state.store_provenance(log, c.select(k.alias("dataset"), first.alias("entry")), 0, F.lit("2024-05-01"))
    again = F.to_json(F.struct(F.concat(F.lit("again "), "c_name").alias("label")))
    state.store_provenance(log, c.where(k % 3 == 0).select(k.alias("dataset"), again.alias("entry")), 1, F.lit("2024-05-02"))
    return state.provenance_of(log).select("dataset", F.col("entry")["label"].alias("label"), "downloaded_at", F.col("entry")["nation"].alias("nation"))


# --- the index of bands, and the incremental cycle ----------------------------------------------


@query(f"WITH {fx.VERSIONS_SQL}, {CANDIDATES} SELECT * FROM cand")
def band_index_pairs(spark, d):
    """The pairs that three batches find with the index."""
    docs = _representatives(spark, d)
    prints = minhash.marked_fingerprints(docs).select("id", F.col("id").alias("name"), "masked", "sig")
    prints, index = stage(prints, "prints"), BandIndex(spark, new_path(spark, "band-index"))
    for batch in range(3):
        index.add(prints.where(F.pmod(F.xxhash64("id"), F.lit(3)) == batch), batch)
    return index.pairs(0).unionByName(index.pairs(1)).unionByName(index.pairs(2))


def _incremental(spark, d, n: int = 3) -> Reconciler:
    """Versions of documents, in batches by doc_id; some of an earlier batch arrive again with each."""
    docs = fx.versions(spark, d).select("id", F.lit("b").alias("release_batch"), F.length("extracted_text").cast("bigint").alias("size_bytes"), "extracted_text", "doc_id")
    docs, own = stage(docs, "incremental-documents"), Reconciler(spark, new_path(spark, "incremental"))
    for batch in range(n):
        own.link(docs.where((F.col("doc_id") % n == batch) | (F.col("doc_id") % (5 * n) == 0)), batch)
    return own


@query(f"""WITH RECURSIVE {fx.VERSIONS_SQL}, {VERIFIED}, dg AS (SELECT id, sha256(extracted_text) AS digest FROM rp), e0 AS (SELECT a.digest AS x, b.digest AS y FROM ver JOIN dg a ON a.id = doc_id_a JOIN dg b ON b.id = doc_id_b),
ed AS (SELECT x, y FROM e0 UNION SELECT y, x FROM e0 UNION SELECT digest, digest FROM dg),
r(x, y) AS (SELECT x, x FROM ed UNION SELECT r.x, ed.y FROM r JOIN ed ON ed.x = r.y) SELECT x AS digest, min(y) AS root FROM r GROUP BY x""")
def incremental_labels(spark, d):
    return _incremental(spark, d).members()


@query(f"WITH {fx.VERSIONS_SQL}, {fx.MEMBERS_SQL} SELECT id FROM v WHERE id NOT IN (SELECT doc_id FROM mb WHERE CAST(group_id AS BIGINT) % 3 = 0)")
def exclude_some_grouped(spark, d):
    """Documents that still look for a group: some are in one, some are not."""
    grouped = fx.members(spark, d).where("CAST(group_id AS BIGINT) % 3 = 0").select(F.col("doc_id").alias("id"))
    return fx.versions(spark, d).select("id").join(grouped, "id", "left_anti")


# --- JSON --------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority || ' ü "q" \\' END AS query, CASE WHEN o_orderkey % 2 = 0 THEN 'src' || (o_orderkey % 9) END AS batch,
CAST(o_custkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN '{"a":[1,null]}' END AS rest, true AS same FROM orders""")
def job_payloads(spark, d):
    """Payloads read into columns and written again: nothing is lost, unknown fields included."""
    k = F.col("o_orderkey")
    own = F.struct(
        F.when(k % 5 != 0, F.concat("o_orderpriority", F.lit(' ü "q" \\'))).alias("query"), F.when(k % 2 == 0, F.concat(F.lit("src"), (k % 9).cast("string"))).alias("batch"),
        F.col("o_custkey").cast("string").alias("doc_id"), F.when(k % 4 == 0, F.struct(F.array(F.lit(1), F.lit(None).cast("int")).alias("a"))).alias("unknown"),
    )
    jobs = read(spark, d, "orders").select(k.alias("job_id"), F.to_json(own).alias("payload"))
    rows = payload.read_payload(jobs)
    again = payload.read_payload(rows.select("job_id", payload.write_payload(rows).alias("payload"))).select(
        F.col("job_id").alias("again"), *(F.col(c).alias(f"{c}_2") for c in ("query", "batch", "doc_id")), F.col("rest")["unknown"].alias("rest_2")
    )
    both = rows.join(again, F.col("job_id") == F.col("again"))
    equal = F.col("rest")["unknown"].eqNullSafe(F.col("rest_2"))
    for c in ("query", "batch", "doc_id"):
        equal = equal & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    return both.select("job_id", "query", "batch", "doc_id", F.col("rest")["unknown"].alias("rest"), equal.alias("same"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS group_id, count(*) AS n, true AS same FROM lineitem GROUP BY 1")
def segments_as_json(spark, d):
    one = F.struct(
        F.col("l_returnflag").alias("text"), F.concat(F.lit("d"), "l_suppkey").alias("source_doc_id"), F.lit("merge").alias("stage"), F.when(F.col("l_linenumber") % 2 == 0, "high").alias("confidence"),
        F.col("l_linenumber").cast("bigint").alias("anchor_alpha_len"), F.col("l_quantity").cast("bigint").alias("start"),
    )
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("group_id")).agg(F.array_sort(F.collect_list(one)).alias("segments"))
    again = rows.withColumn("again", payload.segments_of(payload.segments_json(F.col("segments"))))
    return again.select("group_id", F.size("again").cast("bigint").alias("n"), (F.to_json("again") == F.to_json("segments")).alias("same"))


@query("""SELECT l_orderkey AS id, '{' || string_agg('"' || l_linenumber || '":"' || CASE WHEN l_returnflag = 'R' THEN 'redacted' WHEN l_returnflag = 'A' THEN 'photo' ELSE 'text' END || '"', ',' ORDER BY l_linenumber) || '}' AS classes,
count(*) AS n_back FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_returnflag FROM lineitem ORDER BY l_orderkey, l_linenumber, l_returnflag) GROUP BY l_orderkey""")
def page_classes_as_json(spark, d):
    shown = F.when(F.col("l_returnflag") == "R", "redacted").when(F.col("l_returnflag") == "A", "photo").otherwise("text")
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("page")).agg(F.min("l_returnflag").alias("l_returnflag"))
    docs = stage(payload.page_classes_json(rows.select("id", "page", shown.alias("class"))), "classes")
    back = payload.page_classes(docs).groupBy("id").agg(F.count("*").alias("n_back"))
    return docs.join(back, "id")


# --- backfills ---------------------------------------------------------------------------------

SOFT_SQL = f"{fx.STATE_SQL}, so AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN extracted_text || chr(10) || chr(10) || '[SOFT_REDACTION_RECOVERED]' || chr(10) || 'soft' ELSE extracted_text END AS extracted_text FROM st)"


def _soft(spark, d):
    own = F.when(F.col("id").cast("bigint") % 3 == 0, state.append_soft_text(F.col("extracted_text"), F.lit("soft"))).otherwise(F.col("extracted_text"))
    return fx.state(spark, d).select("id", own.alias("extracted_text"))


@query(f"WITH {SOFT_SQL} SELECT id FROM so WHERE extracted_text ILIKE '%[SOFT_REDACTION_RECOVERED]%'")
def soft_recovered(spark, d):
    return state.soft_recovered(_soft(spark, d)).select("id")


@query(f"""WITH {SOFT_SQL}, own AS (SELECT id, CASE WHEN extracted_text ILIKE '%[SOFT_REDACTION_RECOVERED]%' THEN extracted_text ELSE (SELECT st.extracted_text FROM st WHERE st.id = so.id) END AS extracted_text FROM so),
c AS (SELECT id, string_split(trim(regexp_replace(lower(extracted_text), '\\s+', ' ', 'g')), ' ') AS w FROM own WHERE extracted_text IS NOT NULL)
SELECT id, CAST(len(w) - 7 AS INTEGER) AS shingle_count, id IN (SELECT id FROM so WHERE extracted_text ILIKE '%[SOFT_REDACTION_RECOVERED]%') AS rebuilt FROM c WHERE len(w) >= 8""")
def backfilled_fingerprints(spark, d):
    """Fingerprints of all texts, then anew of those that something was added to."""
    log = _log(spark, "fingerprints", "id STRING, sig ARRAY<BIGINT>, shingle_count INT", "id")
    state.store_fingerprints(log, minhash.fingerprints(fx.state(spark, d)), 0)
    state.backfill_fingerprints(log, _soft(spark, d), 1)
    return log.latest().select("id", "shingle_count", (F.col("batch") == 1).alias("rebuilt"))


@query(f"""WITH {fx.STATE_SQL}, p AS (SELECT CAST(conv_id AS VARCHAR) AS id, turn AS page, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM p),
ly AS (SELECT id, string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page, text) AS layer FROM n GROUP BY id HAVING avg(n) >= 50),
sh AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS shard FROM documents WHERE doc_id % 4 = 0 AND text <> ''),
w AS (SELECT *, text_processed AND coalesce(extracted_text, '') = '' AND text_source IS NULL AND coalesce(release_batch IN ('src0', 'src1'), false) AS waits FROM st)
SELECT id, md5(coalesce(CASE WHEN waits THEN coalesce(shard, nullif(layer, '')) END, extracted_text, '?')) AS text_md5,
       CASE WHEN waits AND shard IS NOT NULL THEN 'backfill' WHEN waits AND nullif(layer, '') IS NOT NULL THEN 'text_layer' ELSE text_source END AS text_source
FROM w LEFT JOIN sh USING (id) LEFT JOIN ly USING (id)""")
def backfilled_texts(spark, d):
    shards = fx.documents(spark, d).where("CAST(id AS BIGINT) % 4 = 0").select("id", "extracted_text")
    layers = scans.text_layer(read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("page"), "text"))
    rows = state.backfill_texts(fx.state(spark, d), shards, layers, ["src0", "src1"])
    return rows.select("id", F.md5(F.coalesce("extracted_text", F.lit("?"))).alias("text_md5"), "text_source")
