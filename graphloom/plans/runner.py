"""Workloads against an engine: writes, batches, reads, traversals, mixed and stress, and a matrix of runs.

A workload is a frame (n, batch, op, target). A batch's operations of one kind are one set-at-a-time call, whose time
is the latency of the set; the driver loops over batches and kinds alone, never over operations.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import uniform
from graphloom.operators import metrics
from graphloom.operators.graph import Direction
from graphloom.plans import workload
from graphloom.plans.engine import Engine
from graphloom.sources.tables import variants

RESULT = "workload string, op string, batch int, ops long, succeeded long, seconds double"
#: Kinds in the order in which a batch runs them: what is written in a batch is there for its reads.
OPS = ("create_node", "create_edge", "update_node", "read_node", "read_edge", "traverse")
#: The matrix of a whole suite.
USERS, OPERATIONS = (100, 500, 1000), (1000, 5000, 10_000)
PATTERNS, WRITE_RATIOS, CONTENTION = ("random", "sequential", "hotspot", "zipf"), (0.1, 0.3, 0.5), (0.5, 0.8, 1.0)


def _id(kind: str, n: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), n.cast("string"))


def _batched(ops: DataFrame, size: int) -> DataFrame:
    return ops.withColumn("batch", F.floor(F.col("n") / F.lit(max(size, 1))).cast("int")).select("n", "batch", "op", "target")


def write_ops(spark: SparkSession, users: int, each: int, size: int = 1000) -> DataFrame:
    """Each user creates `each` nodes; every tenth but a user's first also gets an edge to the user's node before it."""
    rows = spark.range(users * each).withColumn("i", F.col("id") % each)
    kinds = F.when((F.col("i") > 0) & (F.col("i") % 10 == 0), F.array(F.lit("create_node"), F.lit("create_edge"))).otherwise(F.array(F.lit("create_node")))
    return _batched(rows.select(F.col("id").alias("n"), F.explode(kinds).alias("op"), F.col("id").alias("target")), size)


def batch_ops(spark: SparkSession, n: int, size: int = 100, node: float = 0.7) -> DataFrame:
    """Creations in batches of `size` (1 at least), a share `node` of them of nodes."""
    op = F.when(uniform(F.col("id")) < node, "create_node").otherwise("create_edge")
    return _batched(spark.range(n).select(F.col("id").alias("n"), op.alias("op"), F.col("id").alias("target")), size)


def stress_ops(spark: SparkSession, n: int, n_nodes: int, read: float = 0.7, part: int = 10, size: int = 1000) -> DataFrame:
    """Reads and updates, all on the first n_nodes / part nodes."""
    hot, u = max(n_nodes // part, 1), uniform(F.col("id") + 1)
    op = F.when(uniform(F.col("id")) < read, "read_node").otherwise("update_node")
    return _batched(spark.range(n).select(F.col("id").alias("n"), op.alias("op"), F.floor(u * F.lit(float(hot))).cast("long").alias("target")), size)


def chain(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a chain of n nodes with one more edge from each but the first to an earlier one."""
    i = F.col("n")
    nodes = spark.range(n).select(_id("node", F.col("id")).alias("id"), F.array(F.lit("Person")).alias("labels"), variants({}).alias("props"))
    rows = spark.range(1, n).withColumnRenamed("id", "n")
    back = F.floor(uniform(i) * i).cast("long")
    ends = F.array(F.struct(_id("next", i).alias("id"), (i - 1).alias("s"), i.alias("d"), F.lit("NEXT").alias("type")), F.struct(_id("back", i).alias("id"), i.alias("s"), back.alias("d"), F.lit("BACK").alias("type")))
    edges = rows.select(F.explode(ends).alias("e"))
    return nodes, edges.select("e.id", _id("node", F.col("e.s")).alias("src"), _id("node", F.col("e.d")).alias("dst"), "e.type", variants({}).alias("props"))


def populate(engine: Engine, n_nodes: int) -> None:
    """Nodes, and an edge from every fifth to the one before it."""
    spark = engine.spark
    engine.create_nodes(workload.nodes(spark, n_nodes).drop("version"))
    engine.create_edges(_edges(spark.range(5, max(n_nodes, 5), 5).select(F.col("id").alias("target"))))


def _edges(ops: DataFrame) -> DataFrame:
    t = F.col("target")
    return ops.select(_id("edge", t).alias("id"), _id("node", t).alias("src"), _id("node", t - 1).alias("dst"), F.lit("KNOWS").alias("type"), variants({}).alias("props"))


def _call(engine: Engine, op: str, ops: DataFrame) -> int:
    """Runs operations of one kind as a set; how many succeeded: reads and updates of what isn't there fail."""
    ids = ops.select(_id("node", F.col("target")).alias("id"))
    n = ops.count()
    if op == "create_node":
        return n - engine.create_nodes(ids.select("id", F.array(F.lit("Person")).alias("labels"), variants({}).alias("props"))).count()
    if op == "create_edge":
        return n - engine.create_edges(_edges(ops)).count()
    if op == "update_node":
        return n - engine.update_nodes(ids.withColumn("props", variants({"updated": F.lit(True)}))).count()
    if op == "read_edge":
        return ops.select(_id("edge", F.col("target")).alias("id")).join(engine.edges().select("id"), "id").count()
    if op == "traverse":
        found = engine.neighbors(ids.distinct(), Direction.OUT).groupBy("seed").count()
        found.write.format("noop").mode("overwrite").save()
    return ids.join(engine.nodes().select("id"), "id").count()


def run(engine: Engine, name: str, ops: DataFrame) -> DataFrame:
    """Executes a workload; (workload, op, batch, ops, succeeded, seconds), a row for each set."""
    ops = ops.persist()
    sizes = {(r["batch"], r["op"]): r["count"] for r in ops.groupBy("batch", "op").count().collect()}  # a row a set
    rows = []
    for batch, op in product(sorted({b for b, _ in sizes}), OPS):
        if (batch, op) in sizes:
            own, began = ops.where((F.col("batch") == batch) & (F.col("op") == op)), time.perf_counter()
            done = _call(engine, op, own)
            rows.append((name, op, batch, sizes[batch, op], done, time.perf_counter() - began))
    ops.unpersist()
    return engine.spark.createDataFrame(rows, RESULT)


def summary(results: DataFrame) -> DataFrame:
    """A row for each workload: time, operations, successes, and percentiles of the seconds of a set."""
    sums = results.groupBy("workload").agg(F.sum("seconds").alias("seconds"), F.sum("ops").alias("ops"), F.sum("succeeded").alias("succeeded"))
    return sums.join(metrics.percentiles(results, "workload", "seconds").select("workload", "p50", "p95", "p99"), "workload")


def matrix(users: Iterable[int] = USERS, operations: Iterable[int] = OPERATIONS) -> list[dict]:
    """The runs of a suite: writes, reads by pattern, mixed by ratio and stress by contention, for all users and operations."""
    kinds = [("write", None), *(("read", p) for p in PATTERNS), *(("mixed", w) for w in WRITE_RATIOS), *(("stress", c) for c in CONTENTION), ("batch", None), ("traversal", None)]
    return [{"kind": k, "setting": s, "users": u, "operations": n} for u, n, (k, s) in product(users, operations, kinds)]


def run_one(spark: SparkSession, path: str, *, kind: str, setting=None, users: int, operations: int) -> DataFrame:
    """One run of the matrix in a new engine under path. The contention of a stress run is a label, as is a batch's user."""
    engine, size, n_nodes = Engine(spark, path), max(operations // 4, 1), max(operations, 20)
    name = "-".join(str(x) for x in (kind, setting, users, operations) if x is not None)
    if kind == "write":
        return run(engine, name, write_ops(spark, users, max(operations // users, 1), size))
    if kind == "batch":
        return run(engine, name, batch_ops(spark, operations, size))
    if kind == "traversal":
        nodes, edges = chain(spark, n_nodes)
        engine.create_nodes(nodes)
        engine.create_edges(edges)
        ops = workload.operations(spark, operations, n_nodes, traverse=1.0, workers=users)
        return run(engine, name, _batched(ops, size))
    populate(engine, 3 * n_nodes if kind == "read" else n_nodes)
    if kind == "stress":
        return run(engine, name, stress_ops(spark, operations, n_nodes, size=size))
    options = {"pattern": setting, "write": 0.0, "traverse": 0.0} if kind == "read" else {"write": setting}
    ops = workload.operations(spark, operations, 3 * n_nodes if kind == "read" else n_nodes, workers=users, **options)
    # What is created gets numbers above those that are there.
    fresh = F.when(F.col("op").startswith("create_"), F.col("n") + 3 * n_nodes).otherwise(F.col("target"))
    return run(engine, name, _batched(ops.withColumn("target", fresh), size))


def run_matrix(spark: SparkSession, path: str, runs: list[dict]) -> DataFrame:
    """Runs, one after the other, each in a folder of its own under path; their summaries, also saved as JSON and CSV."""
    found = summary(metrics.union_all([run_one(spark, f"{path}/{i}", **r) for i, r in enumerate(runs)])).persist()
    metrics.save_results(found, f"{path}/results")
    return found
