"""Connected components of a link table by alternating stars, in joins and sums only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.base import cut


def _towards(edges: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One large star, then one small star: every node points to a smaller one of its neighbourhood, links kept."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    large = few(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    root = few(down.groupBy("a").agg(F.min("b").alias("m")))
    small = down.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return few(small.union(root.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(edges: DataFrame, per_task: int | None = None) -> DataFrame:
    """node, root: every node of ``edges`` (columns a, b) with the smallest node it can reach, the root itself left out.

    Rounds are a logarithm of the longest path; each is written to the shared folder. No node's links are collected.
    With ``per_task`` a step has as many tasks as the links need at that many for each, whatever the session's number of
    shuffle partitions: many rounds over few links are then not all overhead. The links are counted first, so they should
    have been written before.
    """
    tasks = edges.count() // per_task + 1 if per_task else 0
    few = (lambda df: df.coalesce(tasks)) if per_task else (lambda df: df)
    pairs = cut(few(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    before = None
    while True:
        sign = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, pairs = sign, cut(_towards(pairs, few))
