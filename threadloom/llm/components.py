"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; edges are (u, v) with v < u on entry and on exit."""
    if large:  # neighbours of both directions; the larger ones are tied to the least
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = near.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of one orderable type).

    Null ends and self links carry no information and are dropped; repeated links count once. The
    least node names its component. Links stay distributed: the driver sees only two sums per round.
    The rounds needed grow with the logarithm of the longest path; more than ``max_rounds`` is an error.
    """
    a, b = edges.columns[:2]
    now = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct(), "links"
    )
    mark = None
    for _ in range(max_rounds):
        now = staged(_star(_star(now, True), False), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components are still changing after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
