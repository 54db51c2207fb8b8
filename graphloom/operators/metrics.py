"""Statistics: latency percentiles by nearest rank, outcomes, histograms, suite summary, lanes, hit rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.values import lane

PERCENTILES = {"p50": 50.0, "p95": 95.0, "p99": 99.0, "p999": 99.9}


def percentiles(rows: DataFrame, group: str, value: str, buckets: int = 64) -> DataFrame:
    """(group, n, min, max, p50, p95, p99, p999); the p-th percentile is the sorted values' item number
    min(floor(n * p / 100), n - 1), from 0.

    Equal values are counted first, and ranks are running sums inside value ranges plus the counts of the ranges
    below, so a group with a large share of all rows is not sorted in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("x")).agg(F.count("*").alias("c"))
    cuts = counts.agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 1000)).first()[0]
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<double>")
    dealt = counts.withColumn("b", F.size(F.filter(edges, lambda e: e < F.col("x"))))
    sizes = dealt.groupBy("g", "b").agg(F.sum("c").alias("s")).withColumn("below", F.coalesce(F.sum("s").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = sizes.groupBy("g").agg(F.sum("s").alias("n"))
    ranked = dealt.join(sizes.drop("s"), ["g", "b"]).join(totals, "g").withColumn("end", F.col("below") + F.sum("c").over(Window.partitionBy("g", "b").orderBy("x")))
    at = lambda p: F.least(F.floor(F.col("n") * F.lit(p) / F.lit(100.0)), F.col("n") - 1)
    pick = [F.max(F.when((at(p) < F.col("end")) & (at(p) >= F.col("end") - F.col("c")), F.col("x"))).alias(name) for name, p in PERCENTILES.items()]
    found = ranked.groupBy("g").agg(F.max("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), *pick)
    return found.withColumnRenamed("g", group)


def outcomes(ops: DataFrame) -> DataFrame:
    """ops (op, ok) to (op, total, succeeded, failed, success_rate)."""
    found = ops.groupBy("op").agg(F.count("*").alias("total"), F.count_if(F.col("ok")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    return found.withColumn("success_rate", F.col("succeeded") / F.col("total"))


def errors(ops: DataFrame) -> DataFrame:
    return ops.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def suite_summary(results: DataFrame) -> DataFrame:
    """results (name, seconds, ops, succeeded, p99) to one row: sums, plain means, weighted success, the best of each."""
    rate = F.try_divide(F.col("ops").cast("double"), "seconds")
    return results.withColumn("rate", rate).agg(
        F.sum("seconds").alias("seconds"), F.sum("ops").alias("ops"), F.avg("rate").alias("mean_throughput"), F.avg("p99").alias("mean_p99"),
        F.try_divide(F.sum("succeeded").cast("double"), F.sum("ops")).alias("success"), F.max("rate").alias("best_throughput"), F.min("p99").alias("best_p99"),
    )


def hit_rate(accesses: DataFrame) -> DataFrame:
    """accesses (tier, hit) to (tier, hits, misses, rate); no traffic counts as rate 0."""
    found = accesses.groupBy("tier").agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return found.withColumn("rate", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")), F.lit(0.0)))


def lru_cache(accesses: DataFrame, capacity: int) -> DataFrame:
    """accesses (key, at; at unique) to (key, cached): whether a cache of `capacity` keys that evicts the least recently
    used one holds the key after them. The last `capacity` keys by last access are found as a top-k, without one sort of all."""
    last = accesses.groupBy("key").agg(F.max("at").alias("at"))
    kept = last.orderBy(F.desc("at")).limit(capacity).select("key", F.lit(True).alias("cached"))
    return last.select("key").join(kept, "key", "left").select("key", F.coalesce("cached", F.lit(False)).alias("cached"))


def lane_stats(rows: DataFrame, lanes: int = 16) -> DataFrame:
    """(lane, n, bytes) of rows (id, bytes)."""
    return rows.groupBy(lane(F.col("id"), lanes).alias("lane")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def engine_stats(by_lane: DataFrame) -> DataFrame:
    return by_lane.agg(F.count("*").alias("lanes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def breakdown(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def save_results(results: DataFrame, path: str) -> None:
    """The results as JSON and as CSV with a header, under path."""
    results.write.mode("overwrite").json(f"{path}/json")
    results.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
