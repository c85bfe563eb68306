"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint gets a nonzero vector of r+1 bits, and every nonzero
vector v of r+1 bits gives a mask: the bits whose own vector has an odd inner
product with v.  The vectors of any r differing bits span at most r dimensions,
so some v is orthogonal to all of them and its mask hides every difference:
each pair within the radius collides in at least one of the 2^(r+1)-1 tables.

Distinct fingerprints are dealt by (mask, masked bits).  Within a bucket a
search over the not yet reached fingerprints finds the components and only a
star for each is returned, never the pairs.  A bucket of more than
``MAX_BUCKET`` distinct fingerprints is not searched in one task: it is dealt
again by masks over the bits that its first mask left free, which cover the
radius in the same way.  About 15 bits are then left, so that no second bucket
can hold more than 2^16 distinct fingerprints.

Defined cases: null and empty texts have fingerprint zero and link like any
other; repeated rows share a fingerprint; a null doc_id does not name a
component unless it is alone; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.names import free_names
from palimpsest.operators.components import connected_components
from palimpsest.staging import drop, stage

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
MAX_BUCKET = 1 << 16
CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    k = min(words, len(found))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(found) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, fp) for each row; uid is a hash of doc_id and text, to find the row again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["uid"], pa.array([fingerprint(t.as_py()) for t in b["text"]], pa.int64())], ["doc_id", "uid", "fp"]
            )

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, uid long, fp long")


def covering_masks(free: int = (1 << BITS) - 1, radius: int = RADIUS) -> list[int]:
    """Masks over the bits of ``free`` such that any ``radius`` of them are all hidden by some mask."""
    bits = [i for i in range(BITS) if free >> i & 1]
    own = {b: 1 + k % ((1 << radius + 1) - 1) for k, b in enumerate(bits)}
    vectors = range(1, 1 << radius + 1)
    return sorted({sum(1 << b for b in bits if (own[b] & v).bit_count() & 1) for v in vectors})


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def stars(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.uint64]]:
    """The components of at least two of ``fps`` under the radius: members without the root, and the root.

    Each search compares a reached fingerprint with those that nothing has reached yet.
    """
    found = []
    while len(fps) > 1:
        root, rest, queue, reached = fps[0], fps[1:], [fps[0]], []
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                new = rest[near]
                reached.append(new)
                queue.extend(new)
                rest = rest[~near]
        if reached:
            found.append((np.concatenate(reached), root))
        fps = rest
    return found


def _search(max_bucket: int, radius: int):
    """Over rows sorted by (mask, key, fp): the stars of each bucket, and the rows of buckets that are too large."""

    def out(a, b, mask) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, mask)], ["src", "dst", "mask"])

    def solve(mask, key, fp) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
        pairs = lo[hi - lo == 2]
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= radius
        src, dst = [fp[pairs + 1][near]], [fp[pairs][near]]
        many = hi - lo > 2
        for i, j in zip(lo[many].tolist(), hi[many].tolist()):
            for members, root in stars(fp[i:j], radius):
                src.append(members)
                dst.append(np.full(len(members), root))
        src, dst = np.concatenate(src).view(np.int64), np.concatenate(dst).view(np.int64)
        if len(src):
            yield out(src, dst, np.zeros(len(src), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the rows of the last bucket so far
        n, over = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            mask, key, fp = (b[c].to_numpy() for c in ("mask", "key", "fp"))
            fp = fp.view(np.uint64)
            if over is not None:  # the rest of a bucket that is too large passes through
                same = (mask == over[0]) & (key == over[1])
                k = int(same.argmin()) if not same.all() else len(same)
                yield out(fp[:k].view(np.int64), fp[:k].view(np.int64), mask[:k])
                mask, key, fp = mask[k:], key[k:], fp[k:]
                if not len(fp):
                    continue
                over = None
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            first = int(change[0]) if len(change) else len(fp)
            if held and (held[0][0][0] != mask[0] or held[0][1][0] != key[0]):
                yield from solve(*map(np.concatenate, zip(*held)))
                held, n = [], 0
            if held and len(change):
                held.append((mask[:first], key[:first], fp[:first]))
                yield from solve(*map(np.concatenate, zip(*held)))
                held, n = [], 0
                mask, key, fp, change = mask[first:], key[first:], fp[first:], change[1:] - first
            if len(change):
                last = int(change[-1])
                yield from solve(mask[:last], key[:last], fp[:last])
                mask, key, fp = mask[last:], key[last:], fp[last:]
            held.append((mask, key, fp))
            n += len(fp)
            if n > max_bucket:
                m, k, f = map(np.concatenate, zip(*held))
                yield out(f.view(np.int64), f.view(np.int64), m)
                over, held, n = (m[0], k[0]), [], 0
        if held:
            yield from solve(*map(np.concatenate, zip(*held)))

    return run


def _dealt(rows: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """Each fingerprint once for each mask that follows its own; sorted by bucket."""
    spark = rows.sparkSession
    if len({a for a, _ in masks}) == 1:
        dealt = rows.select(F.explode(F.array(*[F.lit(_signed(b)) for _, b in masks])).alias("next"), "fp")
    else:  # at most as many rows as masks squared
        table = spark.createDataFrame([(_signed(a), _signed(b)) for a, b in masks], "mask long, next long")
        dealt = rows.join(F.broadcast(table), "mask")
    dealt = dealt.select(F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("next")).alias("key"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key", F.col("fp"))


def links(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (src, dst) whose components are those of the graph of distinct fingerprints within the radius."""
    everything = (1 << BITS) - 1
    level = [(0, m) for m in covering_masks(everything, radius)]
    rows, found = fps.select("fp").distinct().withColumn("mask", F.lit(0).cast("long")), []
    while True:
        last = max(everything.bit_count() - m.bit_count() for _, m in level) <= 16
        limit = max(max_bucket, 1 << 16) if last else max_bucket
        edges = stage(_dealt(rows, level).mapInArrow(_search(limit, radius), "src long, dst long, mask long"), "simhash-links")
        found.append(edges.where("mask = 0"))
        over = edges.where("mask != 0")
        if not over.take(1):
            break
        level = [(m, m | s) for m in {m for _, m in level} for s in covering_masks(everything & ~m, radius)]
        rows = over.select(F.col("src").alias("fp"), "mask")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("src", "dst")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, uid, fp, component_id, keep_uid) for each row; component_id is the smallest doc_id that links reach."""
    rows = stage(fingerprints(docs), "simhash")
    each = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"), F.min("doc_id").alias("least"))
    roots = connected_components(links(each, radius, max_bucket)).select(F.col("node").alias("fp"), "component")
    each = each.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    each = stage(each, "simhash-groups")
    named = each.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    # Many fingerprints may share a component and many rows a fingerprint: both joins read files, so large keys are split.
    named = stage(named, "simhash-names")
    by_fp = stage(each.select("fp", "component").join(named, "component").select("fp", "component_id", F.col("first.uid").alias("keep_uid")), "simhash-by-fp")
    drop(docs.sparkSession, each, named)
    return rows.join(by_fp, "fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id (of repeated rows, one)."""
    uid, kept_id, kept_uid = free_names(docs.columns, "uid", "kept_id", "kept_uid")
    # The hash alone may be another document's, too; with the doc_id it is this one's.
    kept = near_duplicates(docs).where("uid = keep_uid").select(F.col("doc_id").alias(kept_id), F.col("uid").alias(kept_uid)).distinct()
    rows = docs.withColumn(uid, F.xxhash64("doc_id", "text"))
    stays = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(uid) == F.col(kept_uid)), "left_semi")
    return stays.dropDuplicates(["doc_id", uid]).select(*docs.columns)
