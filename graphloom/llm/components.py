"""Connected components of a distributed list of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long); root is the component's smallest node.

    Each round maps every node to the smallest of itself and its neighbours, relabels the links by that map and
    drops what became loops or repeats; stars vanish in one round, chains shrink geometrically. Neither links nor
    nodes reach the driver: only a count per round. Null ends and self-links are ignored; no links give no rows.
    """
    clean = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = materialize(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "step")
        old = edges, roots
        to_a, to_b = step.select("a", F.col("m").alias("x")), step.select(F.col("a").alias("b"), F.col("m").alias("y"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("x <> y")
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("m").alias("root"))
            roots._graphloom_path = step._graphloom_path
        else:
            on = step.select(F.col("a").alias("root"), "m")
            roots = materialize(roots.join(on, "root", "left").select("node", F.coalesce("m", "root").alias("root")), "roots")
            discard(old[1], step)
        discard(old[0])
    if roots is None:
        return links.sparkSession.createDataFrame([], "node long, root long")
    return roots
