import gzip
import random

import pytest
from palimpsest.llm import warc
from palimpsest.staging import new_path


def write(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size long, digest string")
    path = new_path(spark, "test-warc")
    warc.write_warc(pages, path, **more)
    return path


def expect(rows, min_bytes=0):
    first = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        own = first.get(html or "")
        same = page_id == own or len(payload) < min_bytes
        out.append((-1 if page_id is None else page_id, len(payload), warc.base32_sha1(payload), "response" if same else "revisit", None if same else own))
    return sorted(out, key=str)


def got(spark, path, **more):
    return sorted(
        (
            (int(r.record_id[12:-1] or -1), r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to[12:-1]) if r.refers_to else None)
            for r in warc.read_warc(spark, path, **more).collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("range_bytes", [37, 1000, 1 << 20])
def test_round_trip(spark, range_bytes):
    rng = random.Random(range_bytes)
    texts = ["", None, "é\r\n\r\nWARC/1.1", *("".join(rng.choice("abcé\n<>\x1f") for _ in range(rng.randint(1, 3000))) for _ in range(20))]
    rows = [(i, f"http://a/{i} x\n", rng.choice(texts), 1, "d") for i in range(80)] + [(None, None, "lonely", 1, "d"), (7, "u", "lonely too", 1, "d")]
    path = write(spark, rows)
    assert got(spark, path, range_bytes=range_bytes) == expect(rows)
    payloads = {r.record_id: bytes(r.payload).decode() for r in warc.read_warc(spark, path).where("record_type = 'response'").collect()}
    assert payloads["<urn:x-page:>"] == "lonely"


def test_small_payloads_stay(spark):
    rows = [(1, "u", "aa", 1, ""), (2, "u", "aa", 1, ""), (3, "u", "bbbb", 1, ""), (4, "u", "bbbb", 1, "")]
    assert got(spark, write(spark, rows, min_bytes=3)) == expect(rows, 3)


def test_files_are_plain_gzip(spark):
    path = write(spark, [(1, None, "x", 1, ""), (2, "http://b", "y", 1, "")])
    files = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path").collect()]
    text = b"".join(gzip.open(f.removeprefix("file:")).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == 2


def test_large_records(spark):
    rows = [(1, "u", "z" * (17 << 20), 1, ""), (2, "u", "small", 1, ""), (3, "u", "y" * (33 << 20), 1, "")]
    assert got(spark, write(spark, rows), with_payload=False) == expect(rows)


def test_false_magic_is_passed_over(spark, tmp_path):
    record = warc._member("response", 5, "u", warc.base32_sha1(b"p"), 1, b"p")
    (tmp_path / "a.warc.gz").write_bytes(b"\x1f\x8b\x08junk" + gzip.compress(b"not a record") + record + record[:30])
    assert [r.record_id for r in warc.read_warc(spark, f"file://{tmp_path}").collect()] == ["<urn:x-page:5>"]


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op8_warc(spark, str(tmp_path)).count() == 0
