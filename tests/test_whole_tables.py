import pytest

from palimpsest.plans import fixtures, queries


@pytest.fixture
def short_documents(spark, tmp_path):
    """Documents under 80 words: two that are the same, one of their kind alone, an empty and a null one."""
    own = lambda k: " ".join(f"word{k}x{i}" for i in range(75))
    rows = [(1, own(1)), (2, own(1)), (3, own(3)), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_versions_of_every_document(spark, short_documents):
    got = {r.id for r in fixtures.versions(spark, short_documents).collect()}
    assert got == {str(i) for i in range(2, 12)}


def test_groups_come_from_verified_pairs_of_all_documents(spark, short_documents):
    got = {r.group_id: r for r in queries.QUERIES["merge_groups"](spark, short_documents).collect()}
    # Copies are in one group, whatever their number.
    assert set(got) == {"2", "6"}
    assert got["2"].total_redacted == 1 and got["6"].total_redacted == 1
    assert {r.doc_id for r in queries.QUERIES["split_groups"](spark, short_documents).collect()} >= {"2", "3", "4", "5"}


def test_cross_group_merge_fills_from_other_groups(spark):
    sf = "/root/testdata/sf0.001"
    merged = {r.group_id: r for r in queries.QUERIES["merge_groups"](spark, sf).collect()}
    assert any(r.recovered_count > 0 for r in merged.values())
    filled = queries.QUERIES["cross_group_merge"](spark, sf)
    assert all(r.recovered_count > 0 for r in filled.collect())
