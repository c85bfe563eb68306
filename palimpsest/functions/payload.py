"""JSON where tables meet the outside: job payloads, recovered segments, classes of pages, provenance entries.

Text comes in as JSON and goes out as JSON; inside, fields are columns.  What is not
known by name is kept as a map of its JSON, so that a round trip loses nothing.
Null or unreadable JSON gives nulls, and no rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a job's payload; all are optional.
PAYLOAD = ("query", "person", "batch", "doc_id", "output_dir", "date_from", "date_to")
SEGMENTS = "array<struct<text:string,source_doc_id:string,stage:string,confidence:string,anchor_alpha_len:bigint,start:bigint>>"


def _fields(json: Column) -> Column:
    """Each field's value as JSON text; strings come without their quotes."""
    return F.from_json(json, "map<string,string>")


def read_payload(jobs: DataFrame, known: tuple[str, ...] = PAYLOAD, column: str = "payload") -> DataFrame:
    """The jobs with a column for each known field, and ``rest``: the other fields, null if there is none."""
    rows = jobs.withColumn("_fields", _fields(F.col(column)))
    rest = F.map_filter("_fields", lambda k, v: ~k.isin(*known))
    fields = [F.col("_fields").getItem(k).alias(k) for k in known]
    return rows.select(*jobs.columns, *fields, F.when(F.size(rest) > 0, rest).alias("rest"))


def write_payload(rows: DataFrame, known: tuple[str, ...] = PAYLOAD) -> Column:
    """JSON of the known fields that have a value, in the order of their names, and of what is in ``rest``."""
    own = F.map_from_arrays(F.array(*(F.lit(k) for k in sorted(known))), F.array(*(F.col(k).cast("string") for k in sorted(known))))
    own = F.map_filter(own, lambda k, v: v.isNotNull())
    rest = F.coalesce(F.col("rest"), F.from_json(F.lit("{}"), "map<string,string>")) if "rest" in rows.columns else None
    return F.to_json(own if rest is None else F.map_concat(own, rest))


def segments_json(segments: Column) -> Column:
    """Recovered segments as JSON, fields without value included."""
    return F.to_json(segments, {"ignoreNullFields": "false"})


def segments_of(json: Column) -> Column:
    return F.from_json(json, SEGMENTS)


def page_classes_json(pages: DataFrame) -> DataFrame:
    """(id, classes): JSON of page to class, in the order of pages, from one row a page (id, page, class)."""
    own = F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "class")))
    rows = pages.groupBy("id").agg(own.alias("own"))
    as_map = F.map_from_entries(F.transform("own", lambda p: F.struct(p["page"].cast("string"), p["class"])))
    return rows.select("id", F.to_json(as_map).alias("classes"))


def page_classes(docs: DataFrame) -> DataFrame:
    """(id, page, class) from JSON of page to class (id, classes)."""
    return docs.select("id", F.explode(F.from_json("classes", "map<string,string>")).alias("page", "class")).select("id", F.col("page").cast("int").alias("page"), "class")
