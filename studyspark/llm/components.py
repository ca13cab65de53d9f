"""Connected components of an edge table, by alternating large and small stars.

Every round keeps each component's smallest node reachable and shortens paths, so
the number of rounds grows with the logarithm of the longest path.  Each round's
edges are written to the shared folder, which cuts the lineage; nothing is
collected but whether all components are stars yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large star) or the smaller and own (small star) neighbours to the least one."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that both sides of the join are plain shuffles: a hub's neighbours can be split
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    found = written(out.where("a <> b").distinct(), "edges")
    removed(least)
    return found


def _stars_only(edges: DataFrame) -> bool:
    """Does every larger end have one edge, to a node that is no larger end itself?  Then no star changes anything."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b, both long); root: the smallest node reachable.

    Loops and null ends are ignored; repeated and reversed edges count once; no edge gives an empty result."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars_only(now):
        between = _star(now, True)
        removed(now)
        now = _star(between, False)
        removed(between)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
