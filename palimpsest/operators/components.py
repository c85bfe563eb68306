"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and two joins over the edges; the number of
rounds grows with the logarithm of the longest chain.  Each round's edges are
written to the shared folder, so lineage stays short and a lost executor costs
at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.staging import drop, stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (src, dst); a component is named by its smallest node.

    Self-loops, repeated and reversed edges are allowed; rows with a null end are ignored.
    A node that occurs only in self-loops is not returned.
    """
    spark = edges.sparkSession
    src, dst = F.col("src"), F.col("dst")
    now = stage(
        edges.where(src != dst).select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("e")
        )
        new = stage(small.select("e.hi", "e.lo").where("hi != lo").distinct(), "edges")
        new_mark = _mark(new)
        drop(spark, now)
        done, now, mark = new_mark == mark, new, new_mark
        if done:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
