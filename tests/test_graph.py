"""Golden graphs and properties of the graph engine."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import values as V
from graphloom.operators import changelog, graph, metrics, storage
from graphloom.operators.asof import last_before
from graphloom.operators.graph import Direction
from graphloom.operators.store import Store
from graphloom.plans import workload
from graphloom.sources.tables import variants

EDGE = "id string, src string, dst string, type string"


def people(spark):
    rows = [("alice-123", "Person"), ("bob-456", "Person"), ("company-789", "Company")]
    return spark.createDataFrame([(i, [x]) for i, x in rows], "id string, labels array<string>")


def links(spark):
    return spark.createDataFrame([("edge-1", "alice-123", "bob-456", "KNOWS"), ("edge-2", "alice-123", "company-789", "WORKS_AT"), ("edge-3", "bob-456", "company-789", "WORKS_AT")], EDGE)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_demo_graph(spark):
    n, e = people(spark), links(spark)
    assert ids(graph.out_edges(e, "alice-123")) == ["edge-1", "edge-2"]
    assert ids(graph.in_edges(e, "company-789")) == ["edge-2", "edge-3"]
    assert ids(graph.neighbors(n, e, "alice-123", Direction.OUT)) == ["bob-456", "company-789"]
    assert ids(graph.neighbors(n, e, "bob-456", Direction.BOTH)) == ["alice-123", "company-789"]
    assert ids(graph.neighbors(n, e, "nobody", Direction.OUT)) == []
    assert ids(graph.neighbors(n, e, "bob-456", 7)) == []
    assert ids(graph.with_label(n, "Person")) == ["alice-123", "bob-456"]
    assert ids(graph.with_label(n, "person")) == []
    assert spark.range(1).select(V.lane(F.lit("alice-123"))).first()[0] == 10


def test_loops_parallel_edges_and_missing_ends(spark):
    n = spark.createDataFrame([("1", ["X"]), ("2", ["X"])], "id string, labels array<string>")
    e = spark.createDataFrame([("a", "1", "1", "T"), ("b", "1", "2", "T"), ("c", "1", "2", "T"), ("d", "1", "gone", "T")], EDGE)
    assert ids(graph.neighbors(n, e, "1", Direction.OUT)) == ["1", "2"]
    assert {tuple(r) for r in graph.degrees(e).collect()} == {("1", 4, 1), ("2", 0, 2), ("gone", 0, 1)}
    ok, bad = graph.create_edges(e.union(spark.createDataFrame([("x", "no", "no", "T")], EDGE)), n)
    assert ids(ok) == ["a", "b", "c"]
    assert {(r.id, r.reason) for r in bad.collect()} == {("d", "target"), ("x", "source")}
    left, edges = graph.delete_cascade(n, e, spark.createDataFrame([("2",)], "id string"))
    assert ids(left) == ["1"] and ids(edges) == ["a", "d"]


def business(spark, at, **rows):
    """Tables of a few rows in a new folder: name=(schema, rows)."""
    for name, (schema, own) in rows.items():
        spark.createDataFrame(own, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def few(spark, at):
    return business(
        spark, at,
        customer=("c_custkey long, c_nationkey int", [(1, 1), (2, 1), (2, 1)]), supplier=("s_suppkey long, s_nationkey int", [(1, 2)]), part=("p_partkey long", [(1,), (2,)]),
        orders=("o_orderkey long, o_custkey long", [(5, 1), (5, 2), (5, 2), (6, 1)]), nation=("n_nationkey int, n_regionkey int", [(1, 0), (2, 0)]), region=("r_regionkey int", [(0,)]),
        lineitem=("l_orderkey long, l_partkey long, l_suppkey long, l_quantity double", [(5, 1, 1, 1.0), (5, 1, 1, 1.0), (5, 2, 1, 1.0), (6, 2, 1, 1.0), (7, 9, 9, 1.0)]),
    )


def by_sql(at, name, columns):
    import duckdb

    from graphloom.plans.queries import SQL

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    return sorted(con.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall())


def test_degrees_by_keys_hold_no_texts_and_equal_sql(spark, tmp_path):
    from graphloom.plans.queries import QUERIES

    found = QUERIES["degrees"](spark, few(spark, tmp_path / "few"))
    # An order repeated under two customers is one edge at its own end.
    assert {tuple(r) for r in found.where("id like 'order:%'").collect()} == {("order:5", 2, 1), ("order:6", 1, 1), ("order:7", 1, 0)}
    assert sorted(map(tuple, found.collect())) == by_sql(tmp_path / "few", "degrees", found.columns)
    # No text is a key of an aggregate or of a shuffle.
    held = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in x or "Exchange" in x]
    assert held and not [x for x in held if "concat" in x or "contains:" in x or "src#" in x]


def test_degrees_deal_a_large_table_to_more_tasks(spark, tmp_path, monkeypatch):
    from graphloom.sources import tables

    at = few(spark, tmp_path / "few")
    want = sorted(map(tuple, tables.degrees(spark, at).collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 1)
    assert tables.tasks(tables.table(spark, at, "lineitem")) == 5
    found = tables.degrees(spark, at)
    assert "l_partkey" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 5), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, found.collect())) == want


def test_created_edges_are_looked_up_by_keys_and_equal_sql(spark, tmp_path):
    from graphloom.plans.queries import QUERIES

    at = few(spark, tmp_path / "few")
    for name, n in (("create_edges_valid", 2), ("create_edges_rejected", 2)):
        found = QUERIES[name](spark, at)
        assert (rows := sorted(map(tuple, found.collect()))) and len(set(rows)) == n, name
        # Repeated nodes give no repeated edges here, in SQL they do.
        assert rows == sorted(set(by_sql(at, name, found.columns))), name
        held = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x or "Exchange" in x]
        assert held and not [x for x in held if "concat" in x or "id#" in x and "order:" in x]
        assert dict(found.select("src").dtypes)["src"] == "string" and "_src_" not in found.columns
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert text.index("concat") < text.index("Join") and "concat" not in text[text.index("Join") :], name


def test_k_hop_counts_the_shortest_way(spark):
    from graphloom.session import ensure_checkpoints

    ensure_checkpoints(spark)
    rng = random.Random(1)
    pairs = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(40)]
    e = spark.createDataFrame([(str(i), str(a), str(b), "T") for i, (a, b) in enumerate(pairs)], EDGE)
    want, todo = {"0": 0}, ["0"]
    while todo:
        x = todo.pop(0)
        for a, b in pairs:
            for p, q in ((a, b), (b, a)):
                if str(p) == x and str(q) not in want and want[x] < 3:
                    want[str(q)] = want[x] + 1
                    todo.append(str(q))
    got = {r.id: r.distance for r in graph.k_hop(e, spark.createDataFrame([("0",)], "id string"), 3).collect()}
    assert got == want


def test_k_hop_reads_edges_of_the_frontiers_labels_alone(spark, tmp_path):
    from graphloom.session import ensure_checkpoints
    from graphloom.sources import tables

    ensure_checkpoints(spark)
    at = few(spark, tmp_path / "few")
    e = tables.edges(spark, at)
    for seed, k in (("nation:1", 3), ("part:9", 3), ("region:0", 2), ("nowhere", 2), ("nation:8", 1)):
        want = graph.k_hop(e, spark.createDataFrame([(seed,)], "id string"), k)
        assert sorted(map(tuple, tables.k_hop(spark, at, seed, k).collect())) == sorted(map(tuple, want.collect())), seed
    (tmp_path / "few/lineitem.parquet").rename(tmp_path / "few/away")
    business(spark, at, lineitem=("l_orderkey string, l_partkey string, l_suppkey string", [("read", "read", "read")]))
    # No hop from nations leads over line items; a read of these keys fails.
    assert ("customer:2", 1) in {tuple(r) for r in tables.k_hop(spark, at, "nation:1", 1).collect()}


@pytest.mark.parametrize("bound", [0, 200_000])
def test_k_hop_joins_what_it_does_not_broadcast(spark, tmp_path, monkeypatch, bound):
    from graphloom.session import ensure_checkpoints
    from graphloom.sources import tables

    ensure_checkpoints(spark)
    monkeypatch.setattr(graph, "BROADCAST_IDS", bound)
    got = {r.id: r.distance for r in tables.k_hop(spark, few(spark, tmp_path / "few"), "nation:1", 3).collect()}
    assert got == {"nation:1": 0, "customer:1": 1, "customer:2": 1, "region:0": 1, "order:5": 2, "order:6": 2, "nation:2": 2, "part:1": 3, "part:2": 3, "supplier:1": 3}


def test_directions_mirror_each_other(spark):
    n, e = people(spark), links(spark)
    out = {(r.seed, r.id) for r in graph.neighbors(n, e, n, Direction.OUT).collect()}
    assert out == {(r.id, r.seed) for r in graph.neighbors(n, e, n, Direction.IN).collect()}


def log(spark, rows):
    df = spark.createDataFrame(rows, "id string, seq long, op string, p map<string,double>")
    return df.select("id", "seq", "op", F.transform_values("p", lambda _, v: v.cast("variant")).alias("props"))


def replay(rows):
    state, bad = {}, []
    for i, seq, op, p in sorted(rows, key=lambda r: r[1]):
        if op == "PUT":
            state[i] = [dict(p), 1 + len(p), seq]
        elif op == "DELETE":
            state.pop(i, None)
        elif i in state:
            state[i][0].update(p)
            state[i][1] += len(p)
            state[i][2] = seq
        else:
            bad.append((i, seq))
    return state, sorted(bad)


def plain(df):
    return {r.id: [{k: v for k, v in r.p.items()}, r.version, r.seq] for r in df.select("id", F.transform_values("props", lambda _, v: F.try_variant_get(v, "$", "double")).alias("p"), "version", "seq").collect()}


def test_the_log_resolves_as_if_replayed(spark):
    rng = random.Random(2)
    rows = [(f"n{rng.randint(0, 6)}", s, rng.choice(["PUT", "PATCH", "PATCH", "PATCH", "DELETE"]), {rng.choice("abc"): float(s), rng.choice("de"): 1.0}) for s in range(120)]
    rows = [(i, s, op, {} if op == "DELETE" else p) for i, s, op, p in rows]
    want, bad = replay(rows)
    df = log(spark, rng.sample(rows, len(rows)))
    assert plain(changelog.resolve(df)) == want
    assert sorted((r.id, r.seq) for r in changelog.rejected(df).collect()) == bad
    for cut in (0, 40, 119):
        assert plain(changelog.recover(changelog.resolve(df.where(f"seq <= {cut}")), df, cut)) == want
    status = {r.id: r.status for r in changelog.status(df, spark.createDataFrame([(f"n{i}",) for i in range(9)], "id string")).collect()}
    assert {i for i, s in status.items() if s == "live"} == set(want) and status["n8"] == "absent"


def test_updates_merge_and_reject(spark):
    state = log(spark, [("1", 1, "PUT", {"name": 1.0, "city": 2.0})])
    state = state.select("id", "props", F.lit(3).cast("long").alias("version"))
    new = F.create_map(F.lit("name"), F.lit("Bob").cast("variant"), F.lit("ok"), F.lit(True).cast("variant"))
    patches = spark.createDataFrame([("1",), ("9",)], "id string").select("id", new.alias("new"))
    done, bad = changelog.update(state, patches)
    r = done.select("version", V.get_property(F.col("props"), "name", "string").alias("name"), V.get_property(F.col("props"), "city", "double").alias("city"), V.get_property(F.col("props"), "none", "string").alias("none"), V.get_property(F.col("props"), "ok", "bigint").alias("other")).first()
    assert tuple(r) == (5, "Bob", 2.0, None, 1)
    assert ids(bad) == ["9"]
    assert [x.id for x in changelog.checked_version(state, patches.withColumn("expected_version", F.lit(3))).collect()] == ["1"]
    with pytest.raises(ValueError):
        V.get_property(F.col("props"), "x", "decimal")


def test_property_types_survive_files(spark, tmp_path):
    df = spark.range(1).select(variants({"s": F.lit("é"), "i": F.lit(30), "f": F.lit(95.5), "b": F.lit(True), "y": F.lit(bytearray(b"\x00x"))}).alias("props"))
    df.write.parquet(str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    types = {r.k: r.t for r in back.select(F.explode("props").alias("k", "v")).select("k", F.schema_of_variant("v").alias("t")).collect()}
    assert types["s"] == "STRING" and types["f"] == "DOUBLE" and types["b"] == "BOOLEAN" and types["y"] == "BINARY"
    assert back.select(changelog.valid_props(F.col("props"))).first()[0] in (True, False)


def test_merge_keeps_the_newest_and_tombstones_until_full(spark):
    run = lambda rows: spark.createDataFrame(rows, "id string, seq long, op string")
    a, b = run([("a", 1, "PUT"), ("b", 2, "PUT"), ("c", 3, "PUT")]), run([("a", 4, "PUT"), ("d", 5, "PUT"), ("b", 6, "DELETE")])
    assert {(r.id, r.seq) for r in storage.merge([a, b]).collect()} == {("a", 4), ("c", 3), ("d", 5)}
    assert {(r.id, r.op) for r in storage.merge([a, b], full=False).collect()} == {("a", "PUT"), ("b", "DELETE"), ("c", "PUT"), ("d", "PUT")}
    with pytest.raises(ValueError):
        storage.merge([])
    assert storage.stats(spark.createDataFrame([], storage.MANIFEST)).first().levels == 1


def test_store_survives_compaction_repeats_and_reopening(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"n{rng.randint(0, 9)}", s, rng.choice(["PUT", "PATCH", "DELETE"]), {"v": float(s)}) for s in range(90)]
    rows = [(i, s, op, {} if op == "DELETE" else p) for i, s, op, p in rows]
    store = Store(spark, str(tmp_path / "store"))
    assert plain(store.state()) == {}
    for k in range(3):
        assert store.append(log(spark, rows[30 * k : 30 * k + 30]), k)
        assert not store.append(log(spark, rows[:30]), k)
        want = replay(rows[: 30 * k + 30])[0]
        assert plain(store.state()) == want
        if k == 1:
            store.compact()
            assert plain(store.state()) == want
    assert plain(Store(spark, str(tmp_path / "store")).state()) == replay(rows)[0]
    assert store.verify() == [] and store.manifest()["version"] == 5 and store.checkpoint()


def test_late_rows_and_tables_resolve_by_seq(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append(log(spark, [("a", 10, "PUT", {"v": 1.0})]))
    store.compact()
    store.append(log(spark, [("b", 5, "PUT", {"v": 2.0}), ("a", 3, "PUT", {"v": 9.0}), ("a", 11, "PATCH", {"w": 3.0})]))
    want = {"a": [{"v": 1.0, "w": 3.0}, 3, 11], "b": [{"v": 2.0}, 2, 5]}
    for step in (lambda: None, store.flush, store.compact):
        step()
        assert plain(store.state()) == want
        assert plain(store.get(["b", "zz"])) == {"b": want["b"]} and plain(store.get(["a"])) == {"a": want["a"]}


def test_two_writers_and_an_append_during_compaction(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "store")
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda i: Store(spark, path).append(log(spark, [(f"n{i}", i, "PUT", {"v": float(i)})])), range(8)))
    store, other = Store(spark, path), Store(spark, path)
    assert ids(store.state()) == [f"n{i}" for i in range(8)] and store.manifest()["version"] == 8
    reader = store.state()
    table = store._table

    def slow(rows, level):
        found = table(rows, level)
        other.append(log(spark, [(f"late{level}", 100, "PUT", {"v": 0.0})]))
        return found

    monkeypatch.setattr(store, "_table", slow)
    assert store.compact()
    assert ids(other.state()) == ["late0", "late1", *(f"n{i}" for i in range(8))]
    assert ids(reader) == [f"n{i}" for i in range(8)]  # its files are still there
    monkeypatch.undo()
    store.compact()
    kept = {p.name for p in (tmp_path / "store" / "tables").iterdir()}
    assert len(kept) > 1 and store.clean(-1) and len(list((tmp_path / "store" / "tables").iterdir())) == 1
    assert ids(Store(spark, path).state()) == ["late0", "late1", *(f"n{i}" for i in range(8))]


def test_tiered_compaction_keeps_tombstones_and_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert not store.compact("size")
    rows = []
    for k in range(7):
        new = [(f"n{i}", 10 * k + i, "DELETE" if (i + k) % 4 == 0 else "PUT", {} if (i + k) % 4 == 0 else {"v": float(k)}) for i in range(k, k + 4)]
        rows += new
        store.append(log(spark, new), k)
        merged = store.compact("size" if k < 6 else "level")
        assert merged == (k in (4, 6)) or k > 4
        assert plain(store.state()) == replay(rows)[0]
    n = {r.counter: r.n for r in store.counters().collect()}
    assert n["flushes"] == 7 and n["compactions"] >= 1 and n["tables_in"] >= 2 and n["bytes_out"] > 0
    assert {r.level for r in store.manifest_table().collect()} >= {1}
    assert store.compact() and plain(store.state()) == replay(rows)[0] and store.manifest_table().count() == 1
    assert store.tables().where("op = 'DELETE'").count() == 0


def test_damaged_log_rows_are_an_error(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append(log(spark, [("a", 1, "PUT", {"v": 1.0})]))
    folder = str(tmp_path / "store" / store.manifest()["segments"][0]["path"])
    rows = spark.read.parquet(folder).withColumn("seq", F.lit(2).cast("long"))
    rows.coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="checksum mismatch of id a"):
        store.state().collect()


def test_point_reads_skip_tables_and_row_groups(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for k in range(3):
        store.append(log(spark, [(f"{c}{i}", 100 * k + i, "PUT", {"v": 1.0}) for i, c in enumerate("abcdef"[2 * k : 2 * k + 2])]))
        store.flush()
    found = store.get(["c0"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ids(found) == ["c0"] and plan.count("FileScan") == 1 and "EqualTo(id,c0)" in plan


def test_level0_picks_need_four_tables(spark):
    for n in (0, 3, 4, 5):
        m = spark.createDataFrame([(f"t{i}", 0 if i < n else 1, 10, 1, "a", "b") for i in range(7)], storage.MANIFEST)
        assert storage.pick_level0(m).count() == (4 if n >= 4 else 0)
    assert storage.next_level([0, 2, 1]) == 3 and storage.next_level([]) == 1


def test_least_recently_used_keys_go(spark):
    from collections import OrderedDict

    rng, cache, rows = random.Random(3), OrderedDict(), []
    for i in range(300):
        k = f"k{rng.randint(0, 20)}"
        rows.append((k, i))
        cache.pop(k, None)
        cache[k] = True
        if len(cache) > 8:
            cache.popitem(last=False)
    got = {r.key for r in metrics.lru_cache(spark.createDataFrame(rows, "key string, at long"), 8).where("cached").collect()}
    assert got == set(cache)
    assert [spark.range(1).select(V.aligned(F.lit(n))).first()[0] for n in (0, 1, 512, 513)] == [0, 512, 512, 1024]


def test_percentiles_by_nearest_rank(spark):
    rows = [("a", float(i)) for i in range(1, 101)] + [("b", 7.0)] * 50 + [("c", None)]
    got = {r.op: tuple(r)[1:] for r in metrics.percentiles(spark.createDataFrame(rows, "op string, x double"), "op", "x").collect()}
    assert got == {"a": (100, 1.0, 100.0, 51.0, 96.0, 100.0, 100.0), "b": (50, 7.0, 7.0, 7.0, 7.0, 7.0, 7.0)}


def test_last_before_equals_a_plain_search(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aab"), i, rng.choice([None, f"v{i}"])) for i in range(200)]
    got = {r.o: r.out for r in last_before(spark.createDataFrame(rows, "k string, o long, v string"), "k", "o", "v", "out", 8).collect()}
    for k, o, _ in rows:
        assert got[o] == next((v for kk, oo, v in reversed(rows) if kk == k and oo < o and v), None)


def test_scalar_functions(spark):
    one = spark.range(1)
    assert one.select(V.parse_list(F.lit("a,,b,tail"))).first()[0] == ["a", "b"]
    assert [one.select(V.direction_name(F.lit(i))).first()[0] for i in (0, 1, 2, 9)] == ["OUT", "IN", "BOTH", "Unknown(9)"]
    assert V.cache_split(101) == (40, 30, 30)

    def fnv(b):
        h = V.FNV_BASIS
        for x in b:
            h = ((h ^ x) * V.FNV_PRIME) % 2**32
        return h

    texts = ["", "a", "node-🎉", "类型", "alice-123"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.fnv1a(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: fnv(t.encode()) for t in texts}


def test_generated_graphs_repeat_and_have_their_properties(spark):
    a, b = workload.nodes(spark, 500, 3), workload.nodes(spark, 500, 3)
    flat = lambda df: sorted((r[0], r[1]) for r in df.select("id", F.to_json("props")).collect())
    assert flat(a) == flat(b) != flat(workload.nodes(spark, 500, 4))
    keys = {r.label: set(r.k) for r in a.select(F.col("labels")[0].alias("label"), F.map_keys("props").alias("k")).collect()}
    assert keys["Person"] == {"name", "age", "city", "email"} and keys["Order"] == set()
    e = workload.edges(spark, 300, 500, 3)
    assert e.join(a, e.src == a.id, "left_anti").count() == 0
    ops = workload.operations(spark, 2000, 100, pattern="zipf", write=0.3)
    share = {r.op: r["count"] / 2000 for r in ops.groupBy("op").count().collect()}
    assert abs(share["traverse"] - 0.1) < 0.03 and ops.where("target < 0 or target > 99").count() == 0


def test_plans_push_filters_and_join_by_key(spark):
    from graphloom.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().toString()
    for name in ("neighbors_both", "degrees", "create_edges_valid", "delete_cascade", "changelog_replay", "two_hop_paths"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, d)) and "NestedLoop" not in plan(QUERIES[name](spark, d))
    out = plan(QUERIES["scan_edges"](spark, d))
    assert "l_comment" not in out and "o_totalprice" not in out.split("Physical Plan")[1]
    found = {"get_node": "EqualTo(c_custkey,7)", "get_edge": "EqualTo(o_orderkey,5)", "range_scan": "PushedFilters: [Or(", "out_edges": "EqualTo(o_custkey,7)", "in_edges": "EqualTo(l_partkey,5)"}
    for name, want in found.items():
        text = QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        pushed = [line for line in text.splitlines() if "PushedFilters" in line]
        assert any(want in line for line in pushed), name


def test_reads_by_key_equal_reads_of_all(spark):
    from graphloom.sources import tables

    d = "/root/testdata/sf0.001"
    n, e = tables.nodes(spark, d).select("id").cache(), tables.edges(spark, d).select("id", "src", "dst").cache()
    for i in ("customer:7", "part:5", "nation:0", "customer:07", "customer:", "x:1", "order:999999999", "order"):
        assert ids(tables.node(spark, d, i)) == ids(n.where(n.id == i))
    for a, b in (("order:2", "order:3"), ("customer:12", "order:2"), ("a", "z"), ("part:1", "part:1"), ("nation", "nation:3"), ("part:5", "part:50"), ("supplier:9", "tt")):
        assert ids(tables.node_range(spark, d, a, b)) == ids(graph.in_range(n, a, b))
    for i in ("customer:7", "nation:3", "region:1", "order:1", "part:5", "supplier:2", "zz"):
        for end in ("src", "dst"):
            assert ids(tables.edges_at(spark, d, i, end)) == ids(e.where(F.col(end) == i)), (i, end)
    for i in ("placed:5", "located:customer:3", "located:supplier:1", "partof:2", "contains:1:1", "located:x", e.where("id like 'supp%'").first().id):
        assert ids(tables.edge(spark, d, i)) == ids(e.where(e.id == i)), i
