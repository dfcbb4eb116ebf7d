"""Connected components of a graph given as an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each id of edges (a long, b long) and the smallest id that links reach from it.

    In each round every node points to the node of its neighbourhood, itself included, that is least by a hash, and edges
    are contracted along the pointers. A round shrinks long paths by a constant factor, and two rounds take a star of any
    size to a point, so rounds grow as the logarithm of the longest path. Minima are aggregated before they are
    shuffled, so a hot node costs a row for each task. Null ends and loops are dropped; repeated edges count once; an
    empty table gives no rows.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
    left = saved(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found: list[DataFrame] = []
    while left.take(1):
        points = saved(_points(both(left)))
        found.append(points)
        a, b = points.select(F.col("id").alias("a"), F.col("to").alias("a2")), points.select(F.col("id").alias("b"), F.col("to").alias("b2"))
        left = saved(left.join(a, "a").join(b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    if not found:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = found[0].select("id", F.col("to").alias("root"))
    for points in found[1:]:
        out = out.join(points.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    out = saved(out) if len(found) > 1 else out
    least = out.groupBy("root").agg(F.min("id").alias("component"))
    return out.join(least, "root").select("id", "component")


def _points(both: DataFrame) -> DataFrame:
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    return both.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("id"), F.least("m", key("a"))["n"].alias("to"))
