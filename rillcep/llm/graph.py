"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcep.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, component), component the smallest node reachable; only nodes with an edge appear.

    Each half-round is one aggregation to the smallest neighbour and one join, so a hub never lands in a single
    task as a list, and Spark can split its rows: that takes an exchange of its own right below each side of the join,
    which `apart` brings about. Null ends are ignored; self-loops and repeated edges change nothing; no edges gives no
    rows.
    """
    apart = lambda low: low.repartition(F.col("a"), F.lit(0))
    e = staged(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "cc")
    while True:
        both = e.unionByName(e.selectExpr("b as a", "a as b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(apart(low), "a").where("b > a and b <> m").selectExpr("b as a", "m as b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(low), "a").where("b <> m").selectExpr("b as a", "m as b").unionByName(low.selectExpr("a", "m as b")).distinct()
        e = staged(small, "cc")
        roots = e.select(F.col("b").alias("a")).distinct()
        rows, children = e.agg(F.count("*"), F.count_distinct("a")).first()
        if rows == children and e.join(roots, "a", "left_semi").isEmpty():
            break
    return e.selectExpr("a as node", "b as component").unionByName(e.selectExpr("b as node", "b as component").distinct())
