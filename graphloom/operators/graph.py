"""Reads over nodes and edges, each for a set of seeds at a time or for one id.

nodes: id, labels, props, version; edges: id, src, dst, type, props, version. Unknown ids give no rows, not errors.
"""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Direction(IntEnum):
    OUT = 0
    IN = 1
    BOTH = 2


def by_id(rows: DataFrame, id_: str) -> DataFrame:
    return rows.where(F.col("id") == F.lit(id_))


def in_range(rows: DataFrame, first: str, before: str) -> DataFrame:
    """Rows whose id lies in [first, before), compared byte by byte."""
    return rows.where((F.col("id") >= F.lit(first)) & (F.col("id") < F.lit(before)))


def with_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.array_contains("labels", label))


def _seeds(edges: DataFrame, seeds: DataFrame | str | None, end: str) -> DataFrame:
    """Edges with `seed`, the end they start from: of one id, of a frame of ids, or, without seeds, of all edges. An id
    is a filter on the end; a source that can turn it into one on its keys (`sources.tables.edges_at`) does so itself."""
    if seeds is None:
        return edges.withColumn("seed", F.col(end))
    if isinstance(seeds, str):
        return edges.where(F.col(end) == F.lit(seeds)).withColumn("seed", F.col(end))
    return edges.join(seeds.select(F.col("id").alias("seed")).distinct(), F.col(end) == F.col("seed"))


def out_edges(edges: DataFrame, seeds: DataFrame | str | None, kind: str | None = None) -> DataFrame:
    found = edges if kind is None else edges.where(F.col("type") == kind)
    return _seeds(found, seeds, "src")


def in_edges(edges: DataFrame, seeds: DataFrame | str | None, kind: str | None = None) -> DataFrame:
    found = edges if kind is None else edges.where(F.col("type") == kind)
    return _seeds(found, seeds, "dst")


def neighbors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | str | None, direction: Direction | int) -> DataFrame:
    """(seed, id, labels): the distinct nodes at the other ends; ends without a node drop out, other directions give none."""
    ends = {0: [("src", "dst")], 1: [("dst", "src")], 2: [("src", "dst"), ("dst", "src")]}.get(int(direction), [])
    found = None
    for near, far in ends:
        own = _seeds(edges, seeds, near).select("seed", F.col(far).alias("id"))
        found = own if found is None else found.union(own)
    if found is None:
        return nodes.where(F.lit(False)).select(F.col("id").alias("seed"), "id", "labels")
    return found.distinct().join(nodes.select("id", "labels"), "id").select("seed", "id", "labels")


def ends(rows: DataFrame, ids: list[str], end: str, out: bool, parts: int | None = None) -> DataFrame:
    """(id, out_degree, in_degree), 1 and 0, of one end of edges known by the columns ids; a repeated edge counts once.

    Edges meet by their ids for that, not by end, in `parts` tasks if given; sums by end then start before the
    shuffle, so a hub is no single task."""
    once = rows.select(*dict.fromkeys([*ids, end]))
    once = (once.repartition(parts, *ids) if parts else once).distinct()
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return once.select(F.col(end).alias("id"), (one if out else none).alias("out_degree"), (none if out else one).alias("in_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every end of an edge; at each end, rows of one edge id count once. Over tables
    whose keys are known, `sources.tables.degrees` takes those in place of texts."""
    both = ends(edges, ["id"], "src", True).union(ends(edges, ["id"], "dst", False))
    return both.groupBy("id").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"))


def adjacency(edges: DataFrame, end: str = "src") -> DataFrame:
    """(id, edges): each node's distinct edge ids in order, joined by commas. A list is as long as the node's degree."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("edges"))


def _known(candidates: DataFrame, nodes: DataFrame, end: str, how: str) -> DataFrame:
    """candidates joined with the ids of nodes by an end; `_src_` or `_dst_` is the id found."""
    return candidates.join(nodes.select(F.col("id").alias(f"_{end}_")).distinct(), F.col(end) == F.col(f"_{end}_"), how)


def checked_edges(candidates: DataFrame, nodes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """candidates with `reason`: source or target, whichever is first found missing, else null.

    Ids are of any type, those of nodes that of src; targets, if given, are the nodes that dst is looked up among. Where
    all ends have one label its keys can stand for texts, which are longer to shuffle."""
    found = _known(_known(candidates, nodes, "src", "left"), nodes if targets is None else targets, "dst", "left")
    return found.withColumn("reason", F.when(F.col("_src_").isNull(), "source").when(F.col("_dst_").isNull(), "target")).drop("_src_", "_dst_")


def create_edges(candidates: DataFrame, nodes: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): candidates with both ends among nodes, and the others with a reason. Of the valid ones alone,
    a candidate without a source is not looked up by its target."""
    valid = _known(_known(candidates, nodes, "src", "left_semi"), nodes if targets is None else targets, "dst", "left_semi")
    return valid, checked_edges(candidates, nodes, targets).where("reason is not null")


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Paths over an edge of type `first` and one of type `second`: (nodes, edges, length)."""
    a = edges.where(F.col("type") == first).select(F.col("src").alias("n0"), F.col("dst").alias("n1"), F.col("id").alias("e0"))
    b = edges.where(F.col("type") == second).select(F.col("src").alias("n1"), F.col("dst").alias("n2"), F.col("id").alias("e1"))
    found = a.join(b, "n1")
    return found.select(F.array("n0", "n1", "n2").alias("nodes"), F.array("e0", "e1").alias("edges")).withColumn("length", F.size("edges"))


#: Frontiers of a label up to so many ids are broadcast to the edges; larger ones are joined.
BROADCAST_IDS = 200_000


def k_hop(edges: DataFrame, seeds: DataFrame, k: int, direction: Direction | int = Direction.BOTH) -> DataFrame:
    """(id, distance) of all nodes within k edges of a seed."""
    steps = []
    if direction in (0, 2):
        steps.append(("", "", edges.select(F.col("src").alias("at"), F.col("dst").alias("id"))))
    if direction in (1, 2):
        steps.append(("", "", edges.select(F.col("dst").alias("at"), F.col("src").alias("id"))))
    return hops(steps, seeds.select(F.lit("").alias("label"), "id"), k).drop("label")


def hops(steps: list[tuple[str, str, DataFrame]], seeds: DataFrame, k: int) -> DataFrame:
    """(label, id, distance) of all nodes within k steps of a seed (label, id). steps: from a label, to a label, and the
    pairs (at, id) of edges; pairs may repeat. A step is taken only from labels that the frontier has, so other edges
    are not read. Each frontier is checkpointed and counted by label, so the plan stays short; steps end with an empty
    frontier."""
    seen = frontier = seeds.select("label", "id").distinct().withColumn("distance", F.lit(0)).checkpoint()
    for distance in range(1, k + 1):
        counts = {r["label"]: r["count"] for r in frontier.groupBy("label").count().collect()}
        reached = None
        for near, far, pairs in steps:
            if near in counts:
                ids = frontier.where(F.col("label") == near).select(F.col("id").alias("at"))
                own = pairs.join(F.broadcast(ids) if counts[near] <= BROADCAST_IDS else ids, "at", "left_semi").select(F.lit(far).alias("label"), "id")
                reached = own if reached is None else reached.union(own)
        if reached is None:
            break
        frontier = reached.distinct().join(seen.select("label", "id"), ["label", "id"], "left_anti").withColumn("distance", F.lit(distance)).checkpoint()
        seen = seen.union(frontier)
    return seen


def delete_cascade(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of gone (id) and the edges that touch them."""
    ids = gone.select("id").distinct()
    end = lambda e: ids.select(F.col("id").alias(e))
    return nodes.join(ids, "id", "left_anti"), edges.join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_anti")
