"""Registered queries of scalar functions, workloads and upkeep, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import values as V
from graphloom.operators import changelog, graph, metrics, storage
from graphloom.operators.graph import Direction
from graphloom.plans import runner
from graphloom.plans.queries import query
from graphloom.sources.tables import events_log, key, table, variants


@query("select event_id, list_filter(string_split(event_type, 'i')[:-2], lambda x: x <> '') as items from events")
def parse_lists(spark, d):
    """Event types with their i's as the commas of a list: what stands behind the last one is unclosed and drops out."""
    return table(spark, d, "events").select("event_id", V.parse_list(F.translate("event_type", "i", ",")).alias("items"))


@query("select n_nationkey, case n_regionkey when 0 then 'OUT' when 1 then 'IN' when 2 then 'BOTH' else 'Unknown(' || n_regionkey || ')' end as direction from nation")
def direction_names(spark, d):
    return table(spark, d, "nation").select("n_nationkey", V.direction_name(F.col("n_regionkey")).alias("direction"))


@query("select o_custkey as id, cast(8 * count(*) as bigint) as bytes from orders group by o_custkey")
def connection_sizes(spark, d):
    """Bytes of each customer's list of orders."""
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("ids"))
    return lists.select("id", V.connections_size(F.col("ids")).cast("long").alias("bytes"))


@query("select p_partkey, cast(strlen(p_name) + strlen(p_brand) as bigint) as bytes, cast(ceil((strlen(p_name) + strlen(p_brand)) / 512.0) * 512 as bigint) as aligned, cast(p_size * 100 + 511 - (p_size * 100 + 511) % 512 as bigint) as size_aligned from part")
def entry_sizes(spark, d):
    n = V.entry_size(F.col("p_name"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", n.cast("long").alias("bytes"), V.aligned(n).alias("aligned"), V.aligned(F.col("p_size") * 100).alias("size_aligned"))


@query("select event_id, date_trunc('second', ts) as at from events")
def persisted_times(spark, d):
    return table(spark, d, "events").select("event_id", V.persisted_time(F.col("ts")).alias("at"))


@query("select cast(4000 as bigint) as l0, cast(3000 as bigint) as l1, cast(3000 as bigint) as l2")
def cache_shares(spark, d):
    return spark.createDataFrame([V.cache_split(10_001)], "l0 long, l1 long, l2 long")


@query("select cast(((event_id % 100) * 1000 + event_id // 100) % 1000 as bigint) as pick, count(*) as n from events group by 1")
def sequential_access(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").groupBy(V.sequential_pick(e % 100, F.floor(e / 100), 1000).alias("pick")).agg(F.count("*").alias("n"))


@query("select p_size as pick, cast(max(p_partkey % 3) + 1 as integer) as level from part group by p_size")
def merged_levels(spark, d):
    """The level of the table that each group of tables is merged into."""
    return table(spark, d, "part").groupBy(F.col("p_size").alias("pick")).agg(storage.level_after(F.col("p_partkey") % 3).cast("int").alias("level"))


@query("with l as (select user_id, max(event_id) as last_id from events group by user_id), k as (select user_id from l order by last_id desc limit 20) select user_id as key, user_id in (select user_id from k) as cached from l")
def cache_evictions(spark, d):
    """What a cache of 20 users holds after all events: the least recently used go."""
    return metrics.lru_cache(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at")), 20)


@query("select concat('customer:', cast(c_custkey as varchar(20))) as id, c_custkey % 4 = 0 as written from customer")
def checked_updates(spark, d):
    """Patches that expect version 3 to 6 of customers, all of which have version 4 (1 and three properties): others are stale."""
    c = table(spark, d, "customer")
    state = c.select(key("customer", "c_custkey").alias("id"), F.lit(4).cast("long").alias("version"))
    patches = c.select(key("customer", "c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, 4).otherwise(F.lit(5)).alias("expected_version"))
    done = changelog.checked_version(state, patches).select("id", F.lit(True).alias("written"))
    return patches.select("id").join(done, "id", "left").select("id", F.coalesce("written", F.lit(False)).alias("written"))


@query("select concat('customer:', cast(c_custkey as varchar(20))) as id, cast(2 as bigint) as version, c_acctbal as acctbal from customer")
def set_property(spark, d):
    rows = table(spark, d, "customer").select(key("customer", "c_custkey").alias("id"), variants({"acctbal": F.lit(0.0)}).alias("props"), F.lit(1).cast("long").alias("version"), "c_acctbal")
    return changelog.set_property(rows, "acctbal", F.col("c_acctbal")).select("id", "version", V.get_property(F.col("props"), "acctbal", "double").alias("acctbal"))


@query("select op, count(*) as n from (select 'create_node' as op from range(1000) union all select 'create_edge' from range(1000) r(i) where i % 100 > 0 and i % 10 = 0) group by op")
def write_workload(spark, d):
    return runner.write_ops(spark, 10, 100).groupBy("op").agg(F.count("*").alias("n"))


_MIX = "cast(({} * 2654435761) % 4294967296 as double) / cast(4294967296 as double)"


@query(f"select cast(i // 100 as integer) as batch, case when {_MIX.format('i')} < 0.7::double then 'create_node' else 'create_edge' end as op, count(*) as n from range(1000) r(i) group by 1, 2")
def batch_workload(spark, d):
    return runner.batch_ops(spark, 1000, 100).groupBy("batch", "op").agg(F.count("*").alias("n"))


@query(f"select case when {_MIX.format('i')} < 0.7::double then 'read_node' else 'update_node' end as op, cast(floor({_MIX.format('(i + 1)')} * 10.0::double) as bigint) as target, count(*) as n from range(1000) r(i) group by 1, 2")
def stress_workload(spark, d):
    return runner.stress_ops(spark, 1000, 100).groupBy("op", "target").agg(F.count("*").alias("n"))


@query(f"""with p as (select i - 1 as s, i as d from range(1, 1000) r(i) union select i, cast(floor({_MIX.format('i')} * i) as bigint) from range(1, 1000) r(i))
select concat('node-', s) as seed, count(*) as n from p group by s""")
def traversal_workload(spark, d):
    """Outgoing neighbours of every node of a chain with edges back."""
    nodes, edges = runner.chain(spark, 1000)
    return graph.neighbors(nodes, edges, None, Direction.OUT).groupBy("seed").agg(F.count("*").alias("n"))


@query("""select 'mixed' as kind, 27 as runs union all select 'read', 36 union all select 'stress', 27 union all select 'write', 9 union all select 'batch', 9 union all select 'traversal', 9""")
def runner_matrix(spark, d):
    rows = [(r["kind"],) for r in runner.matrix()]
    return spark.createDataFrame(rows, "kind string").groupBy("kind").agg(F.count("*").cast("int").alias("runs"))


@query("""select 'flushes' as counter, cast(3 as bigint) as n union all select 'compactions', 1 union all select 'tables_in', 3 union all select 'tables_out', 1
union all select 'flushed_entries', (select cast(sum(n) as bigint) from (select count(distinct user_id) as n from events group by event_id % 3))""")
def store_counters(spark, d):
    """Latest values by user written in three parts, each flushed, then compacted: the store's counters but those of bytes."""
    from graphloom.operators.store import Store
    from graphloom.session import ensure_checkpoints

    store = Store(spark, f"{ensure_checkpoints(spark)}/counters-{uuid.uuid4().hex}")
    by = Window.partitionBy("user_id", F.col("event_id") % 3).orderBy(F.desc("event_id"))
    rows = table(spark, d, "events").withColumn("i", F.row_number().over(by)).where("i = 1")
    log = rows.select(key("user", "user_id").alias("id"), F.col("event_id").alias("seq"), F.lit("PUT").alias("op"), variants({"value": F.col("value")}).alias("props"))
    for part in range(3):
        store.append(log.where(F.col("seq") % 3 == part))
        store.flush()
    store.compact()
    return store.counters().where("counter not like '%bytes%'")


@query("""select concat('user:', cast(user_id as varchar(20))) as id, max(event_id) as seq from events
where event_type = 'signup' and user_id in (7, 11, 13) group by user_id""")
def store_point_get(spark, d):
    """Three users' records, read from a store's sorted tables by key bounds and row groups."""
    from graphloom.operators.store import Store
    from graphloom.session import ensure_checkpoints

    store = Store(spark, f"{ensure_checkpoints(spark)}/get-{uuid.uuid4().hex}")
    store.append(events_log(spark, d).where("op = 'PUT'"))
    store.flush()
    return store.get(["user:7", "user:11", "user:13"]).select("id", "seq")
