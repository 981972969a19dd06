"""Connected components by alternating large and small stars, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def least_members(edges: DataFrame, space: Workspace) -> DataFrame:
    """(id, least): the smallest id that links reach from each id in ``edges`` (a, b), but for ids that are it.

    Each round joins edges with the least neighbour of a node; a node with many links is a skewed
    join key, which adaptive execution splits, and its least neighbour is found by partial sums.
    Rounds grow with the logarithm of the longest chain. Each is written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    now = space.save(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        new = space.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "star")
        space.drop(now)
        now, last, mark = new, mark, _mark(new)
        if mark == last:
            return now.select(a.alias("id"), b.alias("least"))
