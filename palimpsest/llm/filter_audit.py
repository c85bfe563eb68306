r"""Audit of filters that follow each other: what each removes in every order of them.

A document fails a set of filters, its mask.  Documents are added up to cells by
part and mask; everything else is computed from a part's cells, of which there
are as many as filters have subsets.  All orders are visited by single swaps of
neighbours.  A swap changes two steps only: what fails both filters and nothing
before them goes over from one to the other.  A filter's Shapley value is what
it removes, added up along the walk.

Whether a text has been seen at a smaller doc_id is decided table-wide: rows are
added up by (text, part, labels, doc_id), then by text with the least doc_id and
its rows, so that a text that a third of all rows share meets in one task only as
its few partial rows.  Labels come by a join on doc_id; nothing is sent to all
tasks.

Defined cases: a null text counts as empty, a null source as an empty part; rows
that share doc_id and text fail alike; a row without doc_id is never a duplicate
and makes none; a document with several labels is what any of them says; labels
without document count nowhere; an empty table has no part and gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.staging import stage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"
#: Parts that are walked together.
TOGETHER = 64
MEASURES = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text is too short, repeats its words, has many capitals, or holds signs of markup."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], duplicates: str = "E") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part that fail the filters of a mask, a bit for each in the order of their names.

    ``filters``: columns over ``text`` (never null); ``duplicates``: the name of the filter that text with a smaller doc_id fails.
    """
    names = sorted([*filters, duplicates])
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    mask = sum((F.when(failed, 1 << names.index(name)).otherwise(0) for name, failed in filters.items()), F.lit(0))
    rows = text.select("doc_id", "part", F.sha2("text", 256).alias("digest"), mask.alias("mask"))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").select("digest", "part", "mask", "doc_id", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # By document first, which the join has brought together: then a row for each text, part and label.
    cell = ["digest", "part", "mask", "good", "toxic"]
    once = rows.groupBy(*cell, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = stage(once.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first.alias("first")), "texts")
    least = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    fresh = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = texts.join(least, "digest").select("part", "mask", "good", "toxic", "n", fresh.alias("fresh"))
    bit = 1 << names.index(duplicates)
    both = F.array(F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    cells = split.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "c.mask", "c.n", (F.col("good") * F.col("c.n")).alias("good"), (F.col("toxic") * F.col("c.n")).alias("toxic"))
    return cells.groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES))


def swaps(n: int) -> Iterator[int]:
    """Places whose element is swapped with the next one: n! - 1 swaps that visit all orders of n."""
    if n < 2:
        return
    front = False  # whether the last element has gone through the others to the front
    for inner in [*swaps(n - 1), None]:
        yield from range(n - 1) if front else range(n - 2, -1, -1)
        front = not front
        if inner is not None:
            yield inner + front


def walk(cells: np.ndarray, n: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(order, removed at each step) of all orders; cells: (parts, 2^n, measures), removed: (parts, n, measures)."""
    masks = np.arange(1 << n)

    def failing(every: int, none: int) -> np.ndarray:
        """What fails every filter of one set and none of another."""
        return cells[:, (masks & every == every) & (masks & none == 0)].sum(axis=1)

    order = list(range(n))
    removed = np.stack([failing(1 << f, (1 << f) - 1) for f in order], axis=1)
    yield tuple(order), removed
    for i in swaps(n):
        one, other = order[i : i + 2]
        shared = failing(1 << one | 1 << other, sum(1 << f for f in order[:i]))
        removed = removed.copy()
        removed[:, i], removed[:, i + 1] = removed[:, i + 1] + shared, removed[:, i] - shared
        order[i : i + 2] = other, one
        yield tuple(order), removed


STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audited(names: list[str]):
    n = len(names)

    def table(parts: list[str], cells: np.ndarray) -> pa.RecordBatch:
        bits = 1 << np.arange(n)
        failed = np.stack([cells[:, np.arange(1 << n) & b != 0, 0].sum(axis=1) for b in bits], axis=1)
        total, alone = cells[:, :, 0].sum(axis=1), cells[:, bits, 0]
        shapley, orders, steps = np.zeros_like(failed), [], []
        for order, removed in walk(cells, n):
            filters = list(order)
            shapley[:, filters] += removed[:, :, 0]
            orders.append(order)
            kept = total[:, None] - removed[:, :, 0].cumsum(axis=1)
            steps.append(np.stack([kept, removed[:, :, 0], failed[:, filters] - removed[:, :, 0], alone[:, filters], removed[:, :, 1], removed[:, :, 2]]))
        numbers = np.stack(steps, axis=2)  # measure, part, order, step
        of = np.array(orders)
        numbers = [*numbers.reshape(len(numbers), -1), shapley[:, of].reshape(-1)]
        a_part = of.size
        named = ["".join(names[f] for f in order) for order in orders for _ in order]
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p in parts for _ in range(a_part)], pa.string()), pa.array(named * len(parts), pa.string()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(parts) * len(orders))),
             *(pa.array(x, pa.int64()) for x in numbers)],
            [c.split()[0] for c in STEP.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for i in range(0, len(rows), TOGETHER):
                some = rows[i : i + TOGETHER]
                cells = np.zeros((len(some), 1 << n, len(MEASURES)), np.int64)
                for k, r in enumerate(some):
                    for c in r["cells"]:
                        cells[k, c["mask"]] = [c[m] for m in MEASURES]
                yield table([r["part"] for r in some], cells)

    return run


def audit(cells: DataFrame, names: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step, of cells (part, mask, n, good, toxic)."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return parts.mapInArrow(_audited(names), STEP)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit(mask_cells(docs, labels, text_filters(F.col("text"))), list("ABCDE"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS mask
    FROM w LEFT JOIN l USING (doc_id)
),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[:step - 1] AS before FROM o, range(1, 6) r(step)),
q AS (
    SELECT part, filter_order, step, f,
           coalesce(sum(n) FILTER (WHERE translate(mask, before || f, '') = mask), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') = mask), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') <> mask), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE mask = f), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') = mask), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') = mask), 0) AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, f, before
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM q
"""
