"""Candidate pairs and their verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import DEFAULTS, Settings
from palimpsest.functions.minhash import bands, in_slices, marked_fingerprints
from palimpsest.functions.text import clean_text, clean_words, complementary, email_headers, has_marker, looks_like_email, marker_count, strip_markers
from palimpsest.operators.cells import compared
from palimpsest.staging import stage

#: Bands and rows that suit a threshold of similarity.
BANDS = {0.70: (14, 9), 0.75: (11, 11), 0.80: (9, 13), 0.85: (8, 16), 0.90: (5, 25), 0.95: (3, 42)}


def recall(jaccard: float, settings: Settings = DEFAULTS) -> float:
    """The chance that two documents of this similarity share a band: at 0.70, 0.44 with 14 bands of 9 rows and 0.99 with 25 of 5."""
    return 1 - (1 - jaccard**settings.rows_per_band) ** settings.bands


def text_classes(docs: DataFrame) -> DataFrame:
    """(id, class_id) of each document with a text; equal texts are a class, named by its least id."""
    rows = docs.where(F.col("extracted_text").isNotNull()).select("id", F.sha2("extracted_text", 256).alias("digest"))
    rows = stage(rows, "digests")
    least = stage(rows.groupBy("digest").agg(F.min("id").alias("class_id")), "classes")
    # Both sides come straight from files, so that a text that many documents share is split among tasks.
    return rows.join(least, "digest").select("id", "class_id")


def representatives(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that stand for their class."""
    return docs.join(classes.where("id = class_id").select("id"), "id", "left_semi")


def lsh_candidates(prints: DataFrame, settings: Settings = DEFAULTS, query_ids: DataFrame | None = None) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of documents (id, sig) that share a band; one of them in ``query_ids`` (id), if given.

    All pairs of a band's key are made that have a member of ``query_ids``, as each is to be verified: copies are to be
    left out before, by ``representatives``.  Keys that many documents share are split by Spark's handling of skewed joins.
    """
    if query_ids is not None:
        prints = prints.select("id", "sig").join(query_ids.select("id").distinct().withColumn("masked", F.lit(True)), "id", "left").select("id", "sig", F.coalesce("masked", F.lit(False)).alias("masked"))
    return banded_pairs(prints.select("id", "sig", F.lit(True).alias("masked") if query_ids is None else "masked"), settings)


def banded_pairs(prints: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As ``lsh_candidates``, of documents (id, sig, masked): at least one of a pair is masked."""
    return keyed_pairs(prints.select("id", "masked", band_keys(settings)))


def band_keys(settings: Settings = DEFAULTS) -> Column:
    """The ``keys`` of a signature's bands, in their order: a fifth of the signature."""
    return F.transform(bands(F.col("sig"), settings.bands, settings.rows_per_band), lambda x: x["key"]).alias("keys")


def keyed_pairs(keyed: DataFrame) -> DataFrame:
    """As ``banded_pairs``, of documents (id, masked, keys)."""
    rows = keyed.select("id", "masked", F.posexplode("keys").alias("band", "key"))
    a, b = rows.where("masked").alias("a"), rows.alias("b")
    # Two that are masked meet once.
    once = (F.col("a.id") != F.col("b.id")) & (~F.col("b.masked") | (F.col("a.id") < F.col("b.id")))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & once)
    return pairs.select(F.least("a.id", "b.id").alias("doc_id_a"), F.greatest("a.id", "b.id").alias("doc_id_b")).distinct()


def min_segment(shorter: int) -> int:
    return max(10, min(50, shorter // 2000))


def common_runs(a: str, b: str, k: int) -> list[tuple[int, int]]:
    """Maximal stretches [start, end) of ``a`` covered by strings of k characters that ``b`` has too; stretches that only touch stay apart."""
    return _runs(Text(a), Text(b), k)


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Text:
    """A text with hashes of its strings of k characters, made once for all texts that it is compared with."""

    def __init__(self, text: str):
        self.text, self.points, self.made = text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), {}

    def grams(self, k: int) -> np.ndarray:
        """Of each string of k characters, the polynomial of its characters in ``_BASE``, modulo 2^64."""
        if ("grams", k) not in self.made:
            n = len(self.points)
            powers = np.full(n, _BASE).cumprod(dtype=np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), (_mixed(self.points) * powers).cumsum(dtype=np.uint64)])
            self.made["grams", k] = (sums[k:] - sums[:-k]) * np.full(n - k + 1, _INVERSE).cumprod(dtype=np.uint64)
        return self.made["grams", k]

    def first_places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes in order, and where each is first."""
        if ("places", k) not in self.made:
            self.made["places", k] = np.unique(self.grams(k), return_index=True)
        return self.made["places", k]


def _mixed(points: np.ndarray) -> np.ndarray:
    """Characters as numbers that have nothing in common with their order."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _runs(a: Text, b: Text, k: int) -> list[tuple[int, int]]:
    if min(len(a.points), len(b.points)) < k:
        return []
    known, first = b.first_places(k)
    grams = a.grams(k)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    hits = np.flatnonzero(known[at] == grams)
    return _stretches(a, b, k, hits, first[at[hits]])


def _stretches(a: Text, b: Text, k: int, hits: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
    """The runs of what starts at ``hits`` in ``a`` and has the hash of what is at ``places`` in ``b``."""
    if not len(hits):
        return []
    # Equal hashes are held against the characters, in stretches that go on side by side in both texts.
    ends = np.flatnonzero((np.diff(hits, append=-1) != 1) | (np.diff(places, append=-1) != 1))
    starts = np.concatenate([[0], ends[:-1] + 1])
    for i, j, n in zip(hits[starts].tolist(), places[starts].tolist(), (ends - starts).tolist()):
        if not np.array_equal(a.points[i : i + n + k], b.points[j : j + n + k]):  # two strings with one hash
            own = {b.text[x : x + k] for x in range(len(b.text) - k + 1)}
            hits = np.array([x for x in range(len(a.text) - k + 1) if a.text[x : x + k] in own], np.int64)
            break
    if not len(hits):
        return []
    cut = np.flatnonzero(np.diff(hits) >= k) + 1
    return [(int(part[0]), int(part[-1]) + k) for part in np.split(hits, cut)]


def common_segments(pairs: DataFrame) -> DataFrame:
    """The pairs (a_text, b_text stripped of markers) with n_segments and common_len, the length of their common runs joined by blanks."""
    columns = [f for f in pairs.schema if f.name not in ("a_text", "b_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = Text("")
        for batch in in_slices(batches):
            n, size = [], []
            for a, b in zip(batch["a_text"].to_pylist(), batch["b_text"].to_pylist()):
                a, b = a or "", b or ""
                if b != last.text:  # pairs come sorted by their second document
                    last = Text(b)
                runs = _runs(Text(a), last, min_segment(min(len(a), len(b))))
                n.append(len(runs))
                size.append(sum(z - s for s, z in runs) + max(len(runs) - 1, 0))
            kept = [batch[f.name] for f in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(size, pa.int64())], [*(f.name for f in columns), "n_segments", "common_len"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns), "n_segments bigint", "common_len bigint"])
    return pairs.mapInArrow(run, schema)


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs with both documents' texts, joined after the pairs are distinct."""
    text = F.coalesce("extracted_text", F.lit("")).alias("text")
    a = docs.select(F.col("id").alias("doc_id_a"), text).withColumnRenamed("text", "raw_a")
    b = docs.select(F.col("id").alias("doc_id_b"), text).withColumnRenamed("text", "raw_b")
    return pairs.join(a, "doc_id_a").join(b, "doc_id_b")


class Segments:
    """The documents of a cell (text, marks, longest) by id, whose strings of k characters get numbers in common once."""

    def __init__(self, rows: dict[str, dict]):
        self.rows, self.texts, self.numbered = rows, {i: Text(r["text"]) for i, r in rows.items()}, {}

    def numbers(self, k: int) -> tuple[dict[str, np.ndarray], list]:
        """Of each document the numbers of its strings of k characters; a document, and where each number is first in it (-1: nowhere)."""
        if k not in self.numbered:
            own = {i: t.grams(k) for i, t in self.texts.items() if len(t.points) >= k}
            known, flat = np.unique(np.concatenate(list(own.values())), return_inverse=True)
            parts = np.split(flat.astype(np.int32), np.cumsum([len(x) for x in own.values()])[:-1])
            self.numbered[k] = dict(zip(own, parts)), [None, np.full(len(known), -1, np.int32)]
            for t in self.texts.values():
                t.made.clear()
        return self.numbered[k]

    def __call__(self, a: str, b: str) -> tuple[int, int, bool, int]:
        """n_segments, common_len, complementary and the longer text's length."""
        x, y = self.rows[a], self.rows[b]
        k = min_segment(min(len(x["text"]), len(y["text"])))
        runs = []
        if min(len(self.texts[a].points), len(self.texts[b].points)) >= k:
            own, last = self.numbers(k)
            if last[0] != b:
                if last[0] is not None:
                    last[1][own[last[0]]] = -1
                # Of repeated numbers the one that is written last counts: the first in the text.
                last[0], last[1][own[b][::-1]] = b, np.arange(len(own[b]) - 1, -1, -1, dtype=np.int32)
            at = last[1][own[a]]
            hits = np.flatnonzero(at >= 0)
            runs = _stretches(self.texts[a], self.texts[b], k, hits, at[hits])
        return len(runs), sum(z - s for s, z in runs) + max(len(runs) - 1, 0), x["marks"] != y["marks"], max(x["longest"], y["longest"], 1)


def segments(pairs: DataFrame, docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id_a, doc_id_b, n_segments, common_len, complementary, longest) of pairs: each text is stripped once, and travels once to each cell."""
    m, raw = settings.markers, F.coalesce("extracted_text", F.lit(""))
    marks = F.concat(*[raw.contains(x).cast("int").cast("string") for x in m])
    data = F.struct(strip_markers(raw, m).alias("text"), marks.alias("marks"), F.length(raw).cast("bigint").alias("longest"))
    rows = docs.select("id", F.length(raw).alias("size"), data.alias("data"))
    return compared(pairs, rows, Segments, "n_segments bigint, common_len bigint, complementary boolean, longest bigint")


def verified_pairs(pairs: DataFrame, docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id_a, doc_id_b, similarity, common_len) of pairs with enough text in common.

    Enough is ``min_overlap_chars`` with a marker that only one of them has, else more than ``plain_overlap_chars``.
    """
    enough = (F.col("common_len") >= settings.min_overlap_chars) & (F.col("complementary") | (F.col("common_len") > settings.plain_overlap_chars))
    return segments(pairs, docs, settings).where(enough).select("doc_id_a", "doc_id_b", (F.col("common_len") / F.col("longest")).alias("similarity"), "common_len")


class Shared:
    """The documents of a cell as sets of strings, which get numbers in common once."""

    def __init__(self, rows: dict[str, list[str]]):
        numbers: dict[str, int] = {}
        self.own = {i: np.array(sorted({numbers.setdefault(s, len(numbers)) for s in shingled}), np.int64) for i, shingled in rows.items()}
        self.last, self.held = None, np.zeros(len(numbers), bool)

    def __call__(self, a: str, b: str) -> tuple[float]:
        if self.last != b:
            if self.last is not None:
                self.held[self.own[self.last]] = False
            self.last, self.held[self.own[b]] = b, True
        both = int(self.held[self.own[a]].sum())
        return (both / (len(self.own[a]) + len(self.own[b]) - both),)


def jaccard(pairs: DataFrame, docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of pairs of documents that have a shingle."""
    size, text = settings.shingle_words, F.col("extracted_text")
    rows = docs.select("id", F.length(text).alias("size"), clean_words(clean_text(text, settings.markers)).alias("data"))
    cell = lambda own: Shared({i: [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] for i, w in own.items()})
    return compared(pairs, rows, cell, "jaccard double")


def verified_copies(docs: DataFrame, classes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id_a, doc_id_b, similarity, common_len) of the representative of each class with its other members.

    As pairs they share every marker, so they have enough in common above ``plain_overlap_chars`` and if they have a marker
    and a fingerprint, as ``candidate_pairs`` asks for.
    """
    m = settings.markers
    own = strip_markers(F.col("extracted_text"), m)
    words = F.size(clean_words(clean_text(F.col("extracted_text"), m)))
    long = redacted(representatives(docs, classes), settings).where(words >= settings.shingle_words)
    long = long.select(F.col("id").alias("doc_id_a"), F.length(own).cast("bigint").alias("common_len"), F.greatest(F.length("extracted_text"), F.lit(1)).alias("longest"))
    long = long.where(F.col("common_len") > settings.plain_overlap_chars)
    copies = classes.where("id != class_id").select(F.col("class_id").alias("doc_id_a"), F.col("id").alias("doc_id_b"))
    return copies.join(long, "doc_id_a").select("doc_id_a", "doc_id_b", (F.col("common_len") / F.col("longest")).alias("similarity"), "common_len")


def header_entries(emails: DataFrame) -> DataFrame:
    """(id, value) of all header values, lower case; whatever the header, and as often as they are there."""
    found = emails.where(looks_like_email(F.col("extracted_text"))).select("id", F.explode(email_headers(F.col("extracted_text"))).alias("value"))
    return found.select("id", F.lower("value").alias("value")).where("value != ''")


def header_values(emails: DataFrame, settings: Settings = DEFAULTS, often: DataFrame | None = None) -> DataFrame:
    """Distinct (id, value) of header values that are not too frequent, or not among those (value) that are said to be."""
    found = stage(header_entries(emails), "headers")
    if often is None:
        often = found.groupBy("value").count().where(F.col("count") > settings.header_limit).select("value")
    return found.join(often, "value", "left_anti").select("id", "value").distinct()


def value_combos(values: DataFrame, matches: int) -> DataFrame:
    """(combo, id): each combination of so many values of a document, of distinct (id, value)."""
    own = values.groupBy("id").agg(F.array_sort(F.collect_set("value")).alias("values"))
    # Combinations grow by one value at a time, always a later one.
    combos = own.select("id", "values", F.explode(F.sequence(F.lit(1), F.size("values"))).alias("last")).select(
        "id", "values", "last", F.array(F.element_at("values", F.col("last"))).alias("combo")
    )
    for _ in range(matches - 1):
        more = combos.where(F.col("last") < F.size("values")).select("id", "values", "combo", F.explode(F.sequence(F.col("last") + 1, F.size("values"))).alias("last"))
        combos = more.select("id", "values", "last", F.concat("combo", F.array(F.element_at("values", F.col("last")))).alias("combo"))
    return combos.select("combo", "id")


def header_buckets(emails: DataFrame, settings: Settings = DEFAULTS, often: DataFrame | None = None) -> DataFrame:
    """(combo, id): each combination of ``header_matches`` values of a document, where another document has it too."""
    combos = stage(value_combos(header_values(emails, settings, often), settings.header_matches), "combos")
    shared = combos.groupBy("combo").agg(F.count("*").alias("n")).where("n > 1").select("combo")
    return combos.join(shared, "combo", "left_semi")


def header_edges(emails: DataFrame, settings: Settings = DEFAULTS, often: DataFrame | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b, similarity): the first document of each bucket with each other one."""
    found = header_buckets(emails, settings, often)
    first = found.groupBy("combo").agg(F.min("id").alias("doc_id_a"))
    pairs = found.join(first, "combo").where("id != doc_id_a").select("doc_id_a", F.col("id").alias("doc_id_b")).distinct()
    return pairs.withColumn("similarity", F.lit(1.0))


def redacted(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents with some marker, whatever its case."""
    return docs.where(has_marker(F.col("extracted_text"), settings.markers))


def candidate_pairs(docs: DataFrame, settings: Settings = DEFAULTS, grouped: DataFrame | None = None) -> DataFrame:
    """Fingerprint, leave out documents that are grouped already (id), and pair those with markers with all."""
    prints = marked_fingerprints(docs, settings)
    if grouped is not None:
        prints = prints.join(grouped.select("id"), "id", "left_anti")
    # Read twice, for both sides of the pairs, and computed once.
    return keyed_pairs(stage(prints.select("id", "masked", band_keys(settings)), "band-keys"))


def base_order(members: DataFrame) -> DataFrame:
    """Members (group_id, id, extracted_text) with their marker counts and rank; rank 1, most markers, is filled from the others."""
    w = Window.partitionBy("group_id").orderBy(F.desc("markers"), "id")
    return members.withColumn("markers", marker_count(F.col("extracted_text"))).withColumn("rank", F.row_number().over(w))
