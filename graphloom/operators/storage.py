"""Sorted runs, their merge, the manifest of tables and what compaction picks from it.

manifest: path, level int, size long, entries long, min_key, max_key. It is one row a file and small, so picking a
group to compact may sort it as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.changelog import latest

MANIFEST = "path string, level int, size long, entries long, min_key string, max_key string"
L0_LIMIT, GROUP, RATIO = 4, 4, 2


def write_run(rows: DataFrame, path: str, key: str = "id", files: int | None = None) -> None:
    """Rows as Parquet, sorted by key inside range-partitioned files, with a bloom filter on the key: point reads skip
    files and row groups by their bounds."""
    dealt = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.fpp#{key}", "0.01").parquet(path)


def merge(runs: list[DataFrame], key: str = "id", order: str = "seq", *, full: bool = True) -> DataFrame:
    """One row a key, the newest by order; a full merge drops tombstones, a partial one keeps them to hide older rows elsewhere."""
    if not runs:
        raise ValueError("no input runs")
    newest = latest(reduce(DataFrame.unionByName, runs), key, order)
    return newest.where("op <> 'DELETE'") if full and "op" in newest.columns else newest


def due(manifest: DataFrame, limit: int = L0_LIMIT) -> DataFrame:
    return manifest.agg(F.count_if(F.col("level") == 0).alias("l0_tables"), (F.count_if(F.col("level") == 0) > limit).alias("due"))


def pick_by_size(manifest: DataFrame) -> DataFrame:
    """The first group, by rising size, of 2 to 4 tables within twice the size of its smallest; of all levels."""
    by = Window.orderBy("size", "path")
    numbered = manifest.withColumn("i", F.row_number().over(by)).withColumn("next", F.lead("size").over(by))
    first = numbered.where(F.col("next") <= RATIO * F.col("size")).agg(F.min_by(F.struct("i", "size"), "i").alias("f"))
    found = numbered.crossJoin(F.broadcast(first)).where((F.col("i") >= F.col("f.i")) & (F.col("i") < F.col("f.i") + GROUP) & (F.col("size") <= RATIO * F.col("f.size")))
    return found.drop("i", "next", "f")


def pick_level0(manifest: DataFrame) -> DataFrame:
    """The first four tables of level 0 by path; none if there are fewer."""
    found = manifest.where("level = 0").orderBy("path").limit(GROUP)
    # Four rows at most and one: both sides are bounded.
    return found.crossJoin(F.broadcast(found.agg((F.count("*") == GROUP).alias("_full_")))).where("_full_").drop("_full_")


def next_level(levels: list[int]) -> int:
    """The level of a table merged from tables of these levels."""
    return max(levels, default=0) + 1


def level_after(level) -> Column:
    """The same as an aggregate over the levels of the tables that are merged."""
    return F.coalesce(F.max(level), F.lit(0)) + 1


def replace(manifest: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    return manifest.join(removed.select("path"), "path", "left_anti").select(*manifest.columns).unionByName(added.select(*manifest.columns))


def missing(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """The listed paths that are not there."""
    return manifest.select("path").join(present.select("path"), "path", "left_anti")


def stats(manifest: DataFrame) -> DataFrame:
    """(tables, size, levels); an empty manifest has one level."""
    return manifest.agg(F.count("*").alias("tables"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"), (F.coalesce(F.max("level"), F.lit(0)) + 1).alias("levels"))


def levels(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("level").agg(F.count("*").alias("tables"), F.sum("size").alias("size"))
