r"""WARC archives: a writer with one gzip member for each record, and a splittable reader.

Writing.  Each page becomes a compressed response record where its text is read.
Pages are grouped by the SHA-1 of their payload; the page with the smallest id of
a group keeps its response, the others become revisit records that refer to it.
Spark's own text sink writes the members, so task commits and retries work as for
any table: a member's last byte is taken off and given back as the line
separator.  That byte is the highest of the record's size, which is zero below
16 MB; larger records go to a folder for their own last byte.

Reading.  Tasks get byte ranges of the files.  A task looks for the gzip magic
in its range, tries to inflate each candidate and takes it for a record if the
text starts with a WARC version and the member's checksum holds.  It owns the
records that start inside its range and reads on past its end to finish the last.

Defined cases: null html counts as empty; a null url leaves the header out;
control characters and blanks in a url are percent-encoded; rows that repeat
page_id and html are responses all; null page_ids are larger than all others,
and pages without id whose group has no other id are responses all; payloads
below ``min_bytes`` are responses; no pages give no archive and no records;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.staging import new_path, stage

DATE = "2024-01-01T00:00:00Z"
LEVEL, RANGE, CHUNK = 6, 8 << 20, 1 << 16
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records from this size on end in another byte than zero.
BIG = 1 << 24
#: Most that the headers of a record add to its payload, besides its url.
HEADERS = 2048


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _member(kind: str, page_id: int | None, url: str | None, digest: str, n: int, payload: bytes, refers: str = "") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers:
        head += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(http)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n") + pack.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, sizes, members = [], [], []
        for page_id, url, html in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"]):
            payload = html.as_py() or b""
            digests.append(base32_sha1(payload))
            sizes.append(len(payload))
            members.append(_member("response", page_id, url, digests[-1], len(payload), payload))
        yield pa.RecordBatch.from_arrays(
            [b["page_id"], b["url"], pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())],
            ["page_id", "url", "digest", "size", "member"],
        )


def _bodies(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, tail = [], []
            for page_id, url, digest, size, first, member in zip(*(b[c].to_pylist() for c in ("page_id", "url", "digest", "size", "first")), b["member"]):
                if page_id == first or size < min_bytes:
                    member = member.as_py()
                else:
                    member = _member("revisit", page_id, url, digest, size, b"", _urn(first))
                body.append(member[:-1])
                tail.append(member[-1])
            yield pa.RecordBatch.from_arrays([pa.array(body, pa.binary()), pa.array(tail, pa.int32())], ["body", "tail"])

    return run


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to files below ``path``."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    sizes = pages.select("page_id", F.sha1(html).alias("sha1"), (F.octet_length(html) + F.coalesce(F.octet_length("url") * 3, F.lit(0)) + HEADERS).alias("most"))
    groups = stage(sizes.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("most").alias("most")), "warc-groups")
    most = groups.agg(F.max("most")).first()[0]
    if most is None:
        pages.sparkSession.createDataFrame([], "value string").write.text(path)
        return
    made = pages.select("page_id", "url", html.alias("html")).mapInArrow(_responses, "page_id long, url string, digest string, size long, member binary")
    # Records are dealt by payload as compressed members; a payload that many pages share is split among tasks.
    firsts = groups.select("sha1", "first").mapInArrow(_as_base32, "digest string, first long")
    records = made.join(firsts, "digest").select("page_id", "url", "digest", "size", "first", "member").mapInArrow(_bodies(min_bytes), "body binary, tail int")
    tails = [0]
    if most >= BIG:
        records = stage(records, "warc-records")
        tails = sorted(r.tail for r in records.select("tail").distinct().collect())  # below 128
    for tail in tails:
        of = records.where(F.col("tail") == tail) if len(tails) > 1 or tail else records
        of.select(F.col("body").cast("string").alias("value")).write.option("lineSep", chr(tail)).text(f"{path}/tail={tail}")


def _as_base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [base64.b32encode(bytes.fromhex(x)).decode() for x in b["sha1"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), b["first"]], ["digest", "first"])


class _Window:
    """A file of which a piece is held."""

    def __init__(self, path: str):
        from pyarrow import fs

        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[5:]
        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, max(0, self.size - at)))


def _inflate(file: _Window, at: int) -> tuple[bytes, int] | None:
    """The text of the member at that place and where it ends; None if there is no WARC member."""
    unpack, parts, where = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            chunk = file.read(where, CHUNK)
            if not chunk:
                return None
            where += len(chunk)
            parts.append(unpack.decompress(chunk))
            if sum(map(len, parts[:2])) >= 7 and len(parts) <= 2 and not b"".join(parts).startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    text = b"".join(parts)
    return (text, where - len(unpack.unused_data)) if text.startswith(b"WARC/1.") else None


def _records(text: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a member."""
    at = 0
    while text.startswith(b"WARC/1.", at):
        end = text.index(b"\r\n\r\n", at)
        lines = text[at:end].decode(errors="replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        yield headers, text[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


READ = "path string, place long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _scan(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        for b in batches:
            for path, start, end in zip(*(b[c].to_pylist() for c in ("path", "start", "stop"))):
                file, rows, held = _Window(path), [], 0
                at, found = start, file.read(start, end - start + len(MAGIC) - 1)
                while (k := found.find(MAGIC, at - start)) >= 0 and start + k < end:
                    at = start + k
                    member = _inflate(file, at)
                    if member is None:
                        at += 1
                        continue
                    for headers, block in _records(member[0]):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                        whole = headers.get("warc-type") == "response"
                        rows.append(
                            (
                                path, at, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"),
                                base32_sha1(payload) if whole else headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                                len(payload) if whole or not stated else int(stated[1]), payload if with_payload else None,
                            )
                        )
                        held += len(payload) * with_payload
                    at = member[1]
                    if held > RANGE:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """A row for each record of the gzip-compressed WARC files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("stop"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "path", "start").mapInArrow(_scan(with_payload), READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_warc(pages, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'x-page:(-?[0-9]+)>', 1) as bigint)")
    return read_warc(spark, path, with_payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )

