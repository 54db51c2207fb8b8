"""A property graph under one folder: the write and read calls of a graph store, each for a whole frame of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from graphloom.functions.values import edge_size, node_size
from graphloom.operators import changelog, graph, metrics
from graphloom.operators.graph import Direction
from graphloom.operators.store import Store
from graphloom.sources.tables import variants


def named():
    """Whether a record has an id that can be a key."""
    return F.coalesce(F.length("id") > 0, F.lit(False))


class Engine:
    """Nodes (id, labels, props) and edges (id, src, dst, type, props) with properties as map<string,variant>.

    Every call that writes is one segment of the change log; what it returns as rejected was not written. Reads see
    all segments. The order of changes goes up by call; within one, rows of an id
    follow as they stand.
    """

    def __init__(self, spark: SparkSession, path: str, lanes: int = 16):
        self.spark, self.lanes = spark, lanes
        self._nodes = Store(spark, f"{path.rstrip('/')}/nodes", "labels array<string>")
        self._edges = Store(spark, f"{path.rstrip('/')}/edges", "src string, dst string, type string")
        self._held: dict[str, DataFrame] = {}

    # -- state
    def nodes(self) -> DataFrame:
        return self._held["nodes"] if self._held else self._nodes.state()

    def edges(self) -> DataFrame:
        return self._held["edges"] if self._held else self._edges.state()

    def warm(self) -> None:
        """Keeps both states, and edges by either end, in memory and on local disks until the next write."""
        self.cool()
        edges = self._edges.state()
        for name, df in (("nodes", self._nodes.state()), ("edges", edges), ("by_src", edges.repartition("src")), ("by_dst", edges.repartition("dst"))):
            self._held[name] = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._held[name].count()

    def cool(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held = {}

    # -- writes
    def _write(self, store: Store, rows: DataFrame, op: str) -> None:
        types = {c: t for c, t in zip(store.columns, self.spark.createDataFrame([], store.schema).schema, strict=True)}
        dealt = rows.withColumn("op", F.lit(op))
        for c, t in types.items():
            if c not in (*dealt.columns, "seq"):
                dealt = dealt.withColumn(c, F.lit(None).cast(t.dataType))
        # A store's order is by id: rows of one call that share an id get numbers of their own, others may share them.
        by = Window.partitionBy("id").orderBy(F.monotonically_increasing_id())
        store.append(dealt.withColumn("seq", (F.row_number().over(by) - 1).cast("long")), relative=True)
        self.cool()

    def create_nodes(self, rows: DataFrame) -> DataFrame:
        """Upserts whole records; returns those rejected for a property type or for a null or empty id."""
        ok = changelog.valid_props(F.col("props")) & named()
        self._write(self._nodes, rows.where(ok), "PUT")
        return rows.where(~ok)

    def update_nodes(self, patches: DataFrame) -> DataFrame:
        """Merges patches (id, props) into their nodes; returns those without a node. If patches have expected_version,
        those whose node has another version by now are returned too: optimistic locking."""
        return self._update(self._nodes, self.nodes(), patches)

    def _update(self, store: Store, state: DataFrame, patches: DataFrame) -> DataFrame:
        found = patches.join(state.select("id", F.col("version").alias("_v_")), "id", "left")
        ok = F.col("_v_").isNotNull()
        if "expected_version" in patches.columns:
            ok &= F.coalesce(F.col("_v_") == F.col("expected_version"), F.lit(False))
        # Decided once: the state changes with the write.
        found = found.withColumn("_ok_", ok).drop("_v_").persist(StorageLevel.MEMORY_AND_DISK)
        self._write(store, found.where("_ok_").drop("_ok_"), "PATCH")
        return found.where("not _ok_").select(*patches.columns)

    def delete_nodes(self, ids: DataFrame) -> None:
        """Deletes nodes and the edges that touch them."""
        gone = ids.select("id").distinct()
        touched = self.edges().join(gone.select(F.col("id").alias("src")), "src", "left_semi").select("id")
        touched = touched.union(self.edges().join(gone.select(F.col("id").alias("dst")), "dst", "left_semi").select("id")).distinct()
        self._write(self._edges, touched.withColumn("props", variants({})), "DELETE")
        self._write(self._nodes, gone.withColumn("props", variants({})), "DELETE")

    def create_edges(self, rows: DataFrame) -> DataFrame:
        """Upserts edges whose ends exist; returns the others with a reason (id, then source, then target)."""
        ok, bad = graph.create_edges(rows.where(named()), self.nodes())
        self._write(self._edges, ok, "PUT")
        return bad.unionByName(rows.where(~named()).withColumn("reason", F.lit("id")))

    def update_edges(self, patches: DataFrame) -> DataFrame:
        """As update_nodes."""
        return self._update(self._edges, self.edges(), patches)

    def delete_edges(self, ids: DataFrame) -> None:
        self._write(self._edges, ids.select("id").distinct().withColumn("props", variants({})), "DELETE")

    # -- reads
    def get_node(self, id_: str) -> DataFrame:
        return graph.by_id(self.nodes(), id_) if self._held else self._nodes.get([id_])

    def get_edge(self, id_: str) -> DataFrame:
        return graph.by_id(self.edges(), id_) if self._held else self._edges.get([id_])

    def out_edges(self, seeds: DataFrame | str, kind: str | None = None) -> DataFrame:
        return graph.out_edges(self._held["by_src"] if self._held else self.edges(), seeds, kind)

    def in_edges(self, seeds: DataFrame | str, kind: str | None = None) -> DataFrame:
        return graph.in_edges(self._held["by_dst"] if self._held else self.edges(), seeds, kind)

    def neighbors(self, seeds: DataFrame | str, direction: Direction | int) -> DataFrame:
        return graph.neighbors(self.nodes(), self.edges(), seeds, direction)

    def stats(self) -> DataFrame:
        """(kind, lane, n, bytes) of nodes and edges."""
        n = self.nodes().select("id", node_size(F.col("id"), F.col("labels"), F.col("props")).alias("bytes"))
        e = self.edges().select("id", edge_size(F.col("id"), F.col("src"), F.col("dst"), F.col("type"), F.col("props")).alias("bytes"))
        lanes = [metrics.lane_stats(x, self.lanes).select(F.lit(k).alias("kind"), "lane", "n", "bytes") for k, x in (("node", n), ("edge", e))]
        return lanes[0].union(lanes[1])

    # -- upkeep
    def flush(self) -> None:
        self._nodes.flush()
        self._edges.flush()

    def compact(self, policy: str = "full") -> None:
        self._nodes.compact(policy)
        self._edges.compact(policy)
        self.cool()

    def counters(self) -> DataFrame:
        """(kind, counter, n) of flushes and compactions."""
        n, e = (x.counters().select(F.lit(k).alias("kind"), "counter", "n") for k, x in (("node", self._nodes), ("edge", self._edges)))
        return n.union(e)

    def verify(self) -> list[str]:
        return self._nodes.verify() + self._edges.verify()
