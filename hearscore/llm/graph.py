"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearscore.session import drop_stage, stage


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``u, v`` with the least neighbour ``m`` of u, and the minima.  These
    are a stored table, so that a node with very many edges is split by the skew
    join like any other large partition."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least.hint("merge"), "u"), least


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the
    smallest node of the component.

    Alternates two steps until every node leads to one root: every node hands its larger
    neighbours to its least one, then its smaller ones (large star and small
    star of Kiveris et al., 2014).  The edges never become more, and the number
    of rounds grows with the logarithm of the nodes in practice.  Self-loops
    and repeated edges are allowed; nodes without an edge are not listed.  The
    tables of a round are deleted after the next one.
    """
    loops = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(),
        "edges",
    )
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        spread, least = _with_least(both)
        large = spread.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stage(large, "large_star")
        starred, nearest = _with_least(large)
        # Both edges of a row at once: the join is planned and run one time.
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        done = (now, least, large, nearest)
        now = stage(starred.select(pair.alias("edge")).select("edge.*").filter("u > v").distinct(), "small_star")
        for table in done:
            drop_stage(table)
        # Done when every node leads to one root: none leads to two, and none
        # that is led to leads on.
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("to"))
        ends = ends.union(now.select("v", F.lit(None).cast("long")))
        roles = ends.groupBy("node").agg(
            F.min("to").alias("least"), F.max("to").alias("most"), F.bool_or(F.col("to").isNull()).alias("led_to")
        )
        if roles.filter("least < most OR (led_to AND least IS NOT NULL)").isEmpty():
            break
    return loops.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
