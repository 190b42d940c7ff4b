"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depframe.session import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` with the least node that it can reach.

    Alternates the large-star and small-star steps: each links the neighbours of a node to the least of them, first those
    above the node, then those below. Edges never grow in number and the graph's depth shrinks geometrically. A step is one
    aggregation and one join by node, so a hub's neighbours are never gathered in one place. Loops and
    repeated edges do no harm; edges with a null end are left out. Every round is written to the shared folder.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    now = materialise(pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        last, now = now, materialise(_star(_star(both, F.col("v") > F.col("u")), F.lit(True)), "edges")
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    out = materialise(nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component")), "components")
    discard(now)
    return out


def _star(edges: DataFrame, linked) -> DataFrame:
    """Links to the least of u and its neighbours each neighbour v for which ``linked`` holds, and u itself; (larger, smaller) distinct."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = edges.join(least, "u")
    out = joined.where(linked).select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m"))
    return out.where("x != m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct()
