import json
import os
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import report
from palimpsest.operators.state import orphaned_files
from palimpsest.sources import outputs, scans
from palimpsest.sources.layout import DocumentTable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    rows = [(str(i), i, f"text {i}", None if i % 10 == 9 else f"VOL0000{i % 10}") for i in range(200)]
    own = DocumentTable(spark, f"file://{tmp_path}/docs", 4)
    docs = spark.createDataFrame(rows, "id string, size_bytes long, extracted_text string, release_batch string")
    own.append(docs.where("CAST(id AS INT) < 100"))
    own.append(docs.where("CAST(id AS INT) >= 100"))
    return own


def test_lookups_read_what_they_need(spark, table):
    assert table.read().count() == 200 and table.read().where("release_batch IS NULL").count() == 20
    one = table.document("12", "VOL00002")
    assert [r.extracted_text for r in one.collect()] == ["text 12"] and len(one.inputFiles()) >= 1
    assert all("release_batch=VOL00002" in f for f in one.inputFiles())
    assert "PartitionFilters: [isnotnull(release_batch" in plan(one) and "EqualTo(id,12)" in plan(one)
    assert [r.extracted_text for r in table.document("12").collect()] == ["text 12"] and table.document("12", "VOL00003").count() == 0
    wanted = spark.createDataFrame([("5",), ("5",), ("150",), ("none",)], "id string")
    many = table.lookups(wanted)
    assert sorted(r.id for r in many.collect()) == ["150", "5"]
    assert plan(many).count("Exchange hashpartitioning") <= 2  # of the wanted ids: distinct, and dealt to the buckets


def test_batches_and_shards_prune_while_running(spark, table):
    batches = spark.createDataFrame([("VOL00001", 1), ("VOL00002", 0), (None, 1)], "release_batch string, take int").where("take = 1").select("release_batch")
    found = table.of_batches(batches)
    assert {r.release_batch for r in found.collect()} == {"VOL00001"} and "dynamicpruning" in plan(found)
    shards = {"VOL00001": "first", "VOL00002": "first"}
    got = table.of_shards(spark.createDataFrame([("first", 1), ("other", 0)], "shard string, take int").where("take = 1").select("shard"), shards)
    assert {(r.release_batch, r.shard) for r in got.collect()} == {("VOL00001", "first"), ("VOL00002", "first")}
    assert got.count() == table.read().where(scans.shard_of(F.col("release_batch"), shards) == "first").count()


def files_below(root):
    return sorted(os.path.relpath(os.path.join(top, n), root) for top, _, names in os.walk(root) for n in names)


def results(spark, texts):
    seg = "array<struct<text:string,source_doc_id:string,stage:string,confidence:string,anchor_alpha_len:bigint,start:bigint>>"
    rows = [(f"g{i}", t, 0 if t is None else 1, [f"d/{i}"], [("ü", "x", "merge", "high", 9, 2)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"group_id string, merged_text string, recovered_count bigint, source_doc_ids array<string>, recovered_segments {seg}")


def test_outputs_as_files(spark, tmp_path):
    found = results(spark, ["a ü b", "c", None])
    docs = spark.createDataFrame([(f"d/{i}", "s t", f"b{i % 2}") for i in range(3)], "id string, source string, release_batch string")
    outputs.write_outputs(report.annotated(found), docs, f"file://{tmp_path}/out")
    expect = ["s%20t/b0/d%2F0_merged.json", "s%20t/b1/d%2F1_merged.json"]
    assert files_below(tmp_path / "out") == expect
    own = json.loads((tmp_path / "out" / expect[0]).read_text())
    assert own["merged_text"] == "a ü b" and own["spans"][0]["start"] == 2
    # What is written is what the results name: no file is an orphan.
    named = found.where("recovered_count > 0").select("recovered_count", F.concat(F.lit("s%20t/b"), F.expr("substring(group_id, 2) % 2").cast("int").cast("string"), F.lit("/d%2F"), F.expr("substring(group_id, 2)"), F.lit("_merged.json")).alias("output_path"))
    assert orphaned_files(spark.createDataFrame([(p,) for p in expect], "path string"), named).count() == 0
    outputs.write_outputs(report.annotated(found), docs, f"file://{tmp_path}/out")  # again: the same files
    assert files_below(tmp_path / "out") == expect


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(outputs.AnnotatedOutputs)
    rows = spark.range(0, 40, 1, 4).select(F.lit("s").alias("source"), F.lit("b").alias("batch"), F.col("id").cast("string").alias("doc"), F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="no"):
        rows.write.format("annotated").mode("append").option("path", f"file://{tmp_path}/out").save()
    for _ in range(50):  # the other tasks may not have been stopped yet
        if not files_below(tmp_path):
            break
        time.sleep(0.1)
    assert files_below(tmp_path) == []


def test_safe_names():
    assert [outputs.safe(x) for x in ("a-1.b", "../x", "..", "", None, "ä")] == ["a-1.b", "..%2Fx", "%2E%2E", "%", "unknown", "%C3%A4"]
