"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with ``m``, the least neighbour of ``u``.  The minimum is a
    written table, so the join has a plain shuffle on either side and adaptive
    execution can split the neighbours of a hub."""
    return edges.join(stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least"), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (u, v: long);
    ``root`` is the smallest node of its component.

    Every step groups by node with partial aggregates and joins the minimum
    back, so no neighbourhood is gathered in one place; edges never grow in
    number.  Each round is written to the shared folder; rounds grow with the
    log of the node count.  Self-loops and nulls are ignored; repeated edges
    count once.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                 "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
                       .distinct(), "large")
        # every neighbour, and the node itself, to the least neighbour
        ends = F.explode(F.array("v", "u")).alias("u")
        now = stored(_with_least(large).select(ends, F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        last, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
