"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the edges; no component is
ever held in one place. Rounds are written to the shared folder, so a lost
executor costs one round, and the number of rounds is logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlake.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of its neighbourhood.

    A node that a third of all edges name is one row per task after the partial
    minimum, and the join that hands the minimum back can be split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(least, "a")
    if large:
        linked = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.where("a != b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b) link; the component is its smallest node.

    Repeated edges and loops change nothing; no edges, no rows.
    """
    now = staged(edges.where("a != b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        now = staged(_star(_star(now, large=True), large=False), "edges")
        # Order-free sum over the edges: stands still when they do.
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == seen:
            break
        seen = mark
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select("b").distinct().select("b", F.col("b").alias("component")).toDF("node", "component"))
