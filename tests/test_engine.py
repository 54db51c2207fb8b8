from pyspark.sql import functions as F

from graphloom.functions.values import get_property
from graphloom.operators.graph import Direction
from graphloom.plans.engine import Engine
from graphloom.sources.tables import variants


def test_a_graph_lives_through_its_calls(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "g"))
    people = spark.createDataFrame([("alice", "Person", 30), ("bob", "Person", 25), ("corp", "Company", None)], "id string, label string, age long")
    nodes = people.select("id", F.array("label").alias("labels"), F.when(F.col("age").isNull(), variants({})).otherwise(variants({"age": F.col("age")})).alias("props"))
    assert e.create_nodes(nodes).count() == 0
    rows = [("e1", "alice", "bob", "KNOWS"), ("e2", "alice", "corp", "WORKS_AT"), ("e3", "bob", "corp", "WORKS_AT"), ("e4", "zed", "corp", "WORKS_AT"), ("e5", "bob", "zed", "KNOWS")]
    bad = e.create_edges(spark.createDataFrame(rows, "id string, src string, dst string, type string").withColumn("props", variants({})))
    assert {(r.id, r.reason) for r in bad.collect()} == {("e4", "source"), ("e5", "target")}
    ids = lambda df, c="id": sorted(r[c] for r in df.select(c).collect())
    assert ids(e.out_edges("alice")) == ["e1", "e2"] and ids(e.in_edges("corp")) == ["e2", "e3"]
    assert ids(e.neighbors("bob", Direction.BOTH)) == ["alice", "corp"]
    patch = spark.createDataFrame([("alice",), ("zed",)], "id string").withColumn("props", variants({"age": F.lit(31), "ok": F.lit(True)}))
    assert ids(e.update_nodes(patch)) == ["zed"]
    stale = spark.createDataFrame([("alice", 1), ("bob", 2)], "id string, expected_version long").withColumn("props", variants({"x": F.lit(1.5)}))
    assert ids(e.update_nodes(stale)) == ["alice"] and e.get_node("bob").first().version == 3
    nameless = spark.createDataFrame([(None, ["X"]), ("", ["X"])], "id string, labels array<string>").withColumn("props", variants({}))
    assert e.create_nodes(nameless).count() == 2 and e.nodes().where("id is null or id = ''").count() == 0
    for _ in range(2):
        a = e.get_node("alice").select("version", "labels", get_property(F.col("props"), "age", "bigint").alias("age")).first()
        assert tuple(a) == (4, ["Person"], 31)
        e.compact()
    e.create_edges(spark.createDataFrame([("e1", "bob", "alice", "KNOWS")], "id string, src string, dst string, type string").withColumn("props", variants({})))
    assert ids(e.out_edges("alice")) == ["e2"] and ids(e.out_edges("bob")) == ["e1", "e3"]
    e.warm()
    assert ids(e.out_edges(spark.createDataFrame([("bob",)], "id string"), "KNOWS")) == ["e1"]
    e.delete_nodes(spark.createDataFrame([("corp",)], "id string"))
    again = Engine(spark, str(tmp_path / "g"))
    assert ids(again.nodes()) == ["alice", "bob"] and ids(again.edges()) == ["e1"] and again.verify() == []
    again.create_nodes(nodes.where("id = 'corp'"))
    assert again.get_node("corp").first().version == 1
    assert {r.kind for r in again.counters().where("counter = 'flushes' and n > 0").collect()} == {"node", "edge"}
    assert {r.kind: r.n for r in again.stats().groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {"node": 3, "edge": 1}
