"""Clusters of similar documents at every threshold, from one spanning forest.

The forest holds, of all ways to connect documents that have a common neighbour,
the most similar ones: cut at any threshold, its trees are the components of all
pairs at least that similar.  It grows in rounds; in each every tree takes its
most similar edge that leads out of it, and pairs of trees keep one edge.  Forests
have fewer edges than documents, so a cut, or another threshold, costs no pass over
pairs or fingerprints.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.config import DEFAULTS, Settings
from palimpsest.operators.cells import compared
from palimpsest.operators.grouping import string_components
from palimpsest.operators.similarity import BANDS, lsh_candidates
from palimpsest.staging import drop, stage


def similar_pairs(prints: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id_a, doc_id_b, similarity) of documents (id, sig) that share a band, by their signatures."""
    # A signature of 128 numbers counts as a text of so many words.
    rows = prints.select("id", F.lit(8 * settings.permutations).alias("size"), F.col("sig").alias("data"))
    return compared(lsh_candidates(prints, settings), rows, Estimates, "similarity double")


class Estimates:
    """The signatures of a cell by id."""

    def __init__(self, rows: dict[str, list[int]]):
        self.own = {i: np.array(sig, np.int64) for i, sig in rows.items()}

    def __call__(self, a: str, b: str) -> tuple[float]:
        return (int((self.own[a] == self.own[b]).sum()) / len(self.own[a]),)


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """The edges (doc_id_a, doc_id_b, similarity) of a forest of the most similar pairs; ties go to the least ids."""
    spark = pairs.sparkSession
    a, b = F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")
    # Least first: the most similar edge, then the least ids.
    edge = F.struct((-F.col("similarity")).alias("far"), "a", "b")
    now = stage(pairs.select(a, b, "similarity").where("a != b").select(F.col("a").alias("ga"), F.col("b").alias("gb"), edge.alias("e")), "forest-pairs")
    forest = now.select("e.*").where("false")
    while now.take(1):
        both = now.select(F.col("ga").alias("g"), "e", "ga", "gb").unionByName(now.select(F.col("gb").alias("g"), "e", "ga", "gb"))
        best = stage(both.groupBy("g").agg(F.min(F.struct("e", "ga", "gb")).alias("x")).select("x.*").distinct(), "forest-chosen")
        forest = forest.unionByName(best.select("e.*"))
        trees = stage(string_components(best.select(F.col("ga").alias("doc_id_a"), F.col("gb").alias("doc_id_b"))), "forest-trees")
        own = lambda x: trees.select(F.col("doc_id").alias(f"g{x}"), F.col("group_id").alias(f"t{x}"))
        # Every tree has taken an edge, so each end has a name in ``trees``.
        out = now.join(own("a"), "ga").join(own("b"), "gb").where("ta != tb")
        new = stage(out.groupBy(F.least("ta", "tb").alias("ga"), F.greatest("ta", "tb").alias("gb")).agg(F.min("e").alias("e")), "forest-pairs")
        drop(spark, now, trees)
        now = new
    return stage(forest.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), (-F.col("far")).alias("similarity")), "forest")


def cut(forest: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, group_id) of the documents that are at least that similar to another one, by cluster."""
    return string_components(forest.where(F.col("similarity") >= threshold).select("doc_id_a", "doc_id_b"))


def split_by_forest(members: DataFrame, forest: DataFrame, split_above: int, thresholds: Sequence[float] = tuple(sorted(BANDS))) -> DataFrame:
    """Members (doc_id, group_id) with groups above a size cut at the least threshold that leaves no part above it.

    Each part that is still too large is cut again, at the next threshold; one that is so at the last is left.  Who has
    no neighbour in its part at the threshold where that is cut leaves the groups.  Parts are named by their least id.
    """
    todo, done = members.select("doc_id", "group_id"), None
    for threshold in thresholds:
        sizes = todo.groupBy("group_id").agg(F.count("*").alias("n"))
        large = stage(sizes.where(F.col("n") > split_above).select("group_id"), "large-groups")
        small = todo.join(large, "group_id", "left_anti").select("doc_id", "group_id")
        done = small if done is None else done.unionByName(small)
        if not large.take(1):
            return done
        todo = stage(todo.join(large, "group_id", "left_semi").select("doc_id", "group_id"), "large-members")
        own = lambda x: todo.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("group_id").alias(f"group_{x}"))
        inside = forest.where(F.col("similarity") >= threshold).join(own("a"), "doc_id_a").join(own("b"), "doc_id_b").where("group_a = group_b")
        todo = stage(string_components(stage(inside.select("doc_id_a", "doc_id_b"), "inside")), "parts")
    return done.unionByName(todo.select("doc_id", "group_id"))
