"""Queries for merged text against what was masked, clusters, reports and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.config import DEFAULTS
from palimpsest.functions import minhash
from palimpsest.functions.text import collapse
from palimpsest.operators import grouping, hierarchy, merge, report, search
from palimpsest.plans import fixtures as fx
from palimpsest.plans.queries import AGGREGATED, SIGNATURES, _found, _representatives, query
from palimpsest.staging import new_path, stage
from palimpsest.tables import read

# --- what was masked, and what was filled in -----------------------------------------------------


@query(rf"""WITH {fx.VERSIONS_SQL}, x AS (SELECT doc_id, words, len(list_filter(range(len(words)), lambda i: i % {fx.EVERY} = {fx.PLACE_A})) AS a, len(list_filter(range(len(words)), lambda i: i % {fx.EVERY} = {fx.PLACE_B})) AS b FROM vw WHERE words IS NOT NULL)
SELECT doc_id, len(words) AS n_words, greatest(a, b) AS total_redacted, b = 0 AND a > 0 AS reverse_merge, 0 AS n_wrong, 0 AS n_miscounted FROM x""")
def merge_truth(spark, d):
    """Both versions of each document merged and held against it: what anchors fill in is a word that was masked, and each recovery takes one mask."""
    docs, k = read(spark, d, "documents").where("text IS NOT NULL"), F.col("doc_id")
    members = docs.select(k.cast("string").alias("group_id"), F.explode(F.array((k * 2).cast("string"), (k * 2 + 1).cast("string"))).alias("doc_id"))
    merged = merge.merge_groups(members, fx.versions(spark, d).select("id", "extracted_text"))
    # Before they meet, texts are reduced to what was hidden in them, and results to what was filled in and is masked still.
    words = F.split(collapse(F.col("text")), " ")
    hidden = F.filter(words, lambda w, i: (i % fx.EVERY).isin(fx.PLACE_A, fx.PLACE_B))
    truth = docs.select("doc_id", F.size(words).cast("bigint").alias("n_words"), hidden.alias("hidden"))
    masks = F.size(F.filter(F.split("merged_text", " "), lambda w: w.isin("[REDACTED]", "[b(6)]")))
    filled = F.transform(F.filter("recovered_segments", lambda s: s["stage"] == "merge"), lambda s: s["text"])
    found = merged.select(F.col("group_id").cast("bigint").alias("doc_id"), "total_redacted", "recovered_count", "reverse_merge", masks.alias("masks"), filled.alias("filled"))
    missing = F.when(F.col("reverse_merge"), F.col("recovered_count")).otherwise(F.col("total_redacted") - F.col("recovered_count") - F.col("masks"))
    wrong = F.size(F.filter("filled", lambda x: ~F.array_contains("hidden", x)))
    return truth.join(found, "doc_id").select("doc_id", "n_words", "total_redacted", "reverse_merge", wrong.alias("n_wrong"), missing.cast("int").alias("n_miscounted"))


# --- clusters ----------------------------------------------------------------------------------

SIMILAR = f"""{SIGNATURES}, bd AS (SELECT id, i // {DEFAULTS.rows_per_band} AS band, string_agg(CAST(x AS VARCHAR), ',' ORDER BY i) AS key FROM m WHERE i < {DEFAULTS.bands * DEFAULTS.rows_per_band} GROUP BY id, i // {DEFAULTS.rows_per_band}),
near AS (SELECT DISTINCT a.id AS x, b.id AS y FROM bd a JOIN bd b USING (band, key) WHERE a.id < b.id)"""
SIMILAR_OF_REPRESENTATIVES = SIMILAR.replace("FROM v)", "FROM rp)")


@query(f"""WITH RECURSIVE {fx.VERSIONS_SQL}, {SIMILAR_OF_REPRESENTATIVES}, ed AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
r(x, y) AS (SELECT x, x FROM ed UNION SELECT r.x, ed.y FROM r JOIN ed ON ed.x = r.y) SELECT x AS doc_id, min(y) AS group_id FROM r GROUP BY x""")
def clusters(spark, d):
    return grouping.clusters(stage(minhash.fingerprints(_representatives(spark, d)), "prints"))


CUTS = (0.70, 0.80, 0.90)


@query(f"""WITH RECURSIVE {fx.VERSIONS_SQL}, {SIMILAR_OF_REPRESENTATIVES}, est AS (SELECT x, y, count(*) FILTER (WHERE a.x = b.x) / 128.0 AS s FROM (SELECT near.x AS x, near.y AS y, a.x AS ax, b.x AS bx FROM near JOIN m a ON a.id = near.x JOIN m b ON b.id = near.y AND b.i = a.i) GROUP BY x, y),
t(t) AS (VALUES (0.70), (0.80), (0.90)), ed AS (SELECT t, x, y FROM est, t WHERE s >= t UNION SELECT t, y, x FROM est, t WHERE s >= t),
r(t, x, y) AS (SELECT t, x, x FROM ed UNION SELECT r.t, r.x, ed.y FROM r JOIN ed ON ed.t = r.t AND ed.x = r.y) SELECT CAST(t AS DOUBLE) AS threshold, x AS doc_id, min(y) AS group_id FROM r GROUP BY t, x""".replace("count(*) FILTER (WHERE a.x = b.x)", "count(*) FILTER (WHERE ax = bx)"))
def clusters_at_thresholds(spark, d):
    """Clusters at three thresholds, cut from one forest."""
    prints = stage(minhash.fingerprints(_representatives(spark, d)), "prints")
    forest = hierarchy.spanning_forest(hierarchy.similar_pairs(prints))
    found = [hierarchy.cut(forest, t).withColumn("threshold", F.lit(t)) for t in CUTS]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("threshold", "doc_id", "group_id")


# --- reports -----------------------------------------------------------------------------------

CITED = """ct AS (SELECT CAST(c_custkey AS VARCHAR) AS group_id, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS place, o_orderkey % 3 AS k FROM customer JOIN orders ON o_custkey = c_custkey),
rs2 AS (SELECT group_id, count(*) AS recovered_count, count(*) FILTER (WHERE k = 0) AS questionable, min(o_orderkey) AS base FROM ct WHERE place <= 4 GROUP BY group_id)"""


def _cited(spark, d):
    """Groups by customer with up to four orders each as sources, the first as base."""
    c = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    keys = c.groupBy(F.col("c_custkey").cast("string").alias("group_id")).agg(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 4).alias("keys"))
    segment = lambda k: F.struct(
        F.lit("x").alias("text"), k.cast("string").alias("source_doc_id"), F.lit("merge").alias("stage"), F.when(k % 3 == 0, "questionable").otherwise("high").alias("confidence"), k.cast("bigint").alias("start"),
    )
    return keys.select(
        "group_id", F.size("keys").cast("bigint").alias("recovered_count"), (F.size("keys") + 1).cast("bigint").alias("total_redacted"),
        F.transform("keys", lambda k: k.cast("string")).alias("source_doc_ids"), F.transform("keys", segment).alias("recovered_segments"),
    )


@query(rf"""WITH {CITED}, nm AS (SELECT group_id, place, CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE 'f' || o_orderkey || '.pdf' END || '  id ' || o_orderkey || CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN '  u/' || o_orderkey ELSE '' END AS line FROM ct WHERE place <= 4),
dn AS (SELECT group_id, string_agg('[' || (place - 1) || '] ' || line, chr(10) ORDER BY place) FILTER (WHERE place > 1) AS donors, min(line) FILTER (WHERE place = 1) AS first, count(*) AS n FROM nm GROUP BY group_id),
lb AS (SELECT rs2.*, CASE WHEN CAST(group_id AS BIGINT) % 3 = 0 THEN 1 WHEN CAST(group_id AS BIGINT) % 7 = 0 THEN recovered_count END AS soft, r_name AS label FROM rs2 LEFT JOIN region ON base % 5 <> 0 AND r_regionkey = base % 10),
mt AS (SELECT *, CASE WHEN recovered_count > coalesce(soft, 0) AND coalesce(soft, 0) > 0 THEN 'cross-document merge + soft redaction removal' WHEN recovered_count > coalesce(soft, 0) THEN 'cross-document merge' ELSE 'soft redaction removal' END AS method FROM lb)
SELECT group_id, CAST(base AS VARCHAR) AS base_id, recovered_count, questionable, method, label,
       'recovered: ' || recovered_count || chr(10) || 'method: ' || method || CASE WHEN questionable > 0 THEN chr(10) || 'questionable: ' || questionable ELSE '' END || coalesce(chr(10) || 'provenance: ' || label, '')
       || chr(10) || 'document: ' || first || chr(10) || CASE WHEN n = 2 THEN 'source:' ELSE 'sources:' END || coalesce(chr(10) || donors, '') AS page
FROM mt JOIN dn USING (group_id)""")
def metadata_pages(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    docs = o.where(k % 5 != 0).select(
        k.cast("string").alias("id"), F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")).alias("original_filename"), F.when(k % 2 == 0, F.concat(F.lit("u/"), k.cast("string"))).alias("pdf_url"),
        F.concat(F.lit("VOL0000"), (k % 10).cast("string")).alias("release_batch"),
    )
    labels = read(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("dataset"), F.col("r_name").alias("label"))
    found, g = _cited(spark, d), F.col("group_id").cast("bigint")
    soft = found.select("group_id", F.when(g % 3 == 0, F.lit(1)).when(g % 7 == 0, F.col("recovered_count")).cast("bigint").alias("soft_count")).where("soft_count IS NOT NULL")
    return report.metadata_pages(found, docs, labels, soft)


@query(f"""WITH {AGGREGATED}, {fx.RESULTS_SQL}, tt AS (SELECT count(*) AS g, coalesce(sum(recovered_count), 0) AS r, coalesce(sum(total_redacted), 0) AS t FROM rs WHERE recovered_count > 0),
more AS (SELECT *, text[1:1] || '…' || length(text) AS shown, replace(group_ids, ',', ', ') || CASE WHEN n_groups > 10 THEN ' (+' || (n_groups - 10) || ' more)' ELSE '' END AS names FROM ag),
lk AS (SELECT normal, string_agg('l/' || g, ' ' ORDER BY i) AS urls FROM (SELECT normal, g, i, row_number() OVER (PARTITION BY normal ORDER BY i) AS n FROM (SELECT normal, unnest(string_split(group_ids, ',')) AS g, unnest(range(len(string_split(group_ids, ',')))) AS i FROM ag) WHERE CAST(g AS BIGINT) % 2 = 0) WHERE n <= 3 GROUP BY normal)
SELECT 'totals' AS section, 0 AS place, g || ' groups, ' || r || ' of ' || t || ' recovered, ' || printf('%.1f%%', 100.0 * r / t) AS line FROM tt
UNION ALL SELECT 'top', row_number() OVER (ORDER BY count DESC, text, category, normal), shown || ' (' || category || ', ' || count || ')' FROM (SELECT * FROM more ORDER BY count DESC, text, category, normal LIMIT 20)
UNION ALL SELECT category, row_number() OVER (PARTITION BY category ORDER BY count DESC, text, normal), shown || ' x' || count || ': ' || names || coalesce(' ' || urls, '') FROM more LEFT JOIN lk USING (normal)""")
def summary_lines(spark, d):
    found = _found(spark, d)
    links = found.select("group_id").distinct().where("CAST(group_id AS BIGINT) % 2 = 0").select("group_id", F.concat(F.lit("l/"), "group_id").alias("url"))
    return report.summary_lines(fx.results(spark, d), found, links)


# --- searches ----------------------------------------------------------------------------------

DATED_SQL = "dt AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS release_batch, CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS DATE) AS sent, text AS extracted_text FROM documents)"


def _dated(spark, d):
    k = F.col("doc_id")
    return read(spark, d, "documents").select(k.cast("string").alias("id"), F.col("source").alias("release_batch"), F.date_add(F.lit("2020-01-01").cast("date"), (k % 1000).cast("int")).alias("sent"), F.col("text").alias("extracted_text"))


@query(f"""WITH {DATED_SQL} SELECT id FROM dt WHERE contains(lower(extracted_text), 'license') AND sent BETWEEN DATE '2020-02-01' AND DATE '2021-12-31' AND release_batch <> 'src1'
AND id IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations WHERE contains(lower(text), 'the')) UNION ALL SELECT id FROM dt WHERE contains(lower(extracted_text), 'an') AND release_batch = 'src1'""")
def combined_search(spark, d):
    docs = stage(_dated(spark, d), "dated")
    index = search.TextIndex(spark, new_path(spark, "text-index"), search.buckets_for(docs))
    index.add(docs.where("CAST(id AS BIGINT) % 2 = 0"), 0)
    index.add(docs.where("CAST(id AS BIGINT) % 2 = 1"), 1)
    emails = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("all_participants"))
    first = search.search(docs.where("release_batch != 'src1'"), "LICENSE", dates=("2020-02-01", "2021-12-31"), person="the", emails=emails, index=index)
    return first.select("id").unionByName(search.search(docs, "an", batch="src1", index=index).select("id"))


@query("""WITH q AS (SELECT item_id AS query_id, text[1:24] AS word FROM benchmark WHERE length(text) >= 24) SELECT query_id, CAST(doc_id AS VARCHAR) AS id FROM q JOIN documents ON contains(lower(text), lower(word))""")
def searches(spark, d):
    """Each benchmark item's opening, looked up in all documents."""
    docs = fx.documents(spark, d)
    index = search.TextIndex(spark, new_path(spark, "text-index"), search.buckets_for(docs))
    index.add(docs, 0)
    wanted = read(spark, d, "benchmark").where("length(text) >= 24").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 24).alias("word"))
    return search.searches(docs, index, wanted)
