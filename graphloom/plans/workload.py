"""Seeded synthetic graphs and access patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import hotspot_pick, sequential_pick, uniform, zipf_pick
from graphloom.sources.tables import variants

#: Labels and edge types of generated graphs.
LABELS = ("Person", "Company", "Product", "Order", "Category")
KINDS = ("KNOWS", "WORKS_AT", "BOUGHT", "LIKES", "REVIEWED", "RELATED_TO")


def _u(seed: int, name: str) -> Column:
    """A repeatable uniform number of a row's id and the name of what is drawn."""
    return (F.xxhash64("n", F.lit(seed), F.lit(name)).bitwiseAND(F.lit(2**52 - 1))).cast("double") / F.lit(float(2**52))


def _int(seed: int, name: str, low: int, high: int) -> Column:
    return (F.floor(_u(seed, name) * F.lit(high - low + 1)) + low).cast("long")


def _word(seed: int, name: str, n: int) -> Column:
    return F.concat(F.lit(f"{name}-"), _int(seed, name, 1, n).cast("string"))


def nodes(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (_int(seed, "label", 1, len(LABELS))).cast("int"))
    id_ = F.concat(F.lit("node-"), F.col("n").cast("string"))
    person = variants({"name": _word(seed, "name", 64), "age": _int(seed, "age", 20, 79), "city": _word(seed, "city", 8), "email": F.concat(id_, F.lit("@example.com"))})
    company = variants({"name": _word(seed, "company", 6), "industry": _word(seed, "industry", 6), "founded": _int(seed, "founded", 1950, 2022), "employees": _int(seed, "employees", 10, 10009)})
    product = variants({"name": F.concat(F.lit("Product-"), id_), "price": 10 + 1000 * _u(seed, "price"), "category": _word(seed, "category", 6), "in_stock": _u(seed, "stock") < 0.5})
    df = spark.range(n).withColumnRenamed("id", "n").withColumn("label", label)
    props = F.when(F.col("label") == "Person", person).when(F.col("label") == "Company", company).when(F.col("label") == "Product", product).otherwise(variants({}))
    return df.select(id_.alias("id"), F.array("label").alias("labels"), props.alias("props")).withColumn("version", (1 + F.size("props")).cast("long"))


def edges(spark: SparkSession, n: int, n_nodes: int, seed: int = 1) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (_int(seed, "kind", 1, len(KINDS))).cast("int"))
    end = lambda name: F.concat(F.lit("node-"), _int(seed, name, 0, max(n_nodes - 1, 0)).cast("string"))
    of = {
        "KNOWS": {"since": _int(seed, "since", 2010, 2022), "strength": _u(seed, "strength")}, "WORKS_AT": {"role": _word(seed, "role", 6), "since": _int(seed, "since", 2010, 2022)},
        "BOUGHT": {"quantity": _int(seed, "quantity", 1, 10), "price": 10 + 1000 * _u(seed, "price")}, "LIKES": {"rating": _int(seed, "rating", 1, 5), "timestamp_ms": _int(seed, "time", 0, 10**12)},
    }
    df = spark.range(n).withColumnRenamed("id", "n").withColumn("type", kind)
    props = variants({})
    for k, p in of.items():
        props = F.when(F.col("type") == k, variants(p)).otherwise(props)
    return df.select(F.concat(F.lit("edge-"), F.col("n").cast("string")).alias("id"), end("src").alias("src"), end("dst").alias("dst"), "type", props.alias("props")).withColumn("version", (1 + F.size("props")).cast("long"))


def operations(spark: SparkSession, n: int, n_nodes: int, *, pattern: str = "random", write: float = 0.1, traverse: float = 0.1, create: float = 0.8, node: float = 0.7, workers: int = 100, seed: int = 1) -> DataFrame:
    """(n, op, target): a mixed workload; traversals first, then writes by ratio, most of them creations."""
    u, v, w, pick = _u(seed, "op"), _u(seed, "kind"), _u(seed, "what"), uniform(F.col("n") + seed)
    what = F.when(w < node, "node").otherwise("edge")
    op = F.when(u < traverse, "traverse").when(u < traverse + (1 - traverse) * write, F.when(v < create, F.concat(F.lit("create_"), what)).otherwise("update_node")).otherwise(F.concat(F.lit("read_"), what))
    target = {"random": F.floor(pick * F.lit(float(n_nodes))).cast("long"), "zipf": zipf_pick(pick, n_nodes), "hotspot": hotspot_pick(pick, n_nodes), "sequential": sequential_pick(F.col("n") % workers, F.floor(F.col("n") / workers), n_nodes)}[pattern]
    return spark.range(n).withColumnRenamed("id", "n").select("n", op.alias("op"), target.alias("target"))
