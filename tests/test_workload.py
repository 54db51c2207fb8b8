import pytest

from graphloom.plans import runner
from graphloom.plans.engine import Engine


@pytest.mark.parametrize("kind, setting, ops", [
    ("write", None, {"create_node": 40, "create_edge": 2}), ("batch", None, None), ("read", "zipf", None), ("traversal", None, {"traverse": 40}), ("stress", 0.8, None),
])
def test_runs_count_what_they_did(spark, tmp_path, kind, setting, ops):
    rows = runner.run_one(spark, str(tmp_path / "g"), kind=kind, setting=setting, users=2, operations=40).collect()
    total = {}
    for r in rows:
        total[r.op] = total.get(r.op, 0) + r.ops
        assert r.seconds > 0 and 0 <= r.succeeded <= r.ops
    if ops:
        assert total == ops and all(r.succeeded == r.ops for r in rows)
    if kind in ("read", "stress"):
        assert sum(total.values()) == 40 and all(r.succeeded == r.ops for r in rows if r.op == "read_node")
    state = Engine(spark, str(tmp_path / "g"))
    if kind == "write":
        assert state.nodes().count() == 40 and {(r.src, r.dst) for r in state.edges().collect()} == {("node-10", "node-9"), ("node-30", "node-29")}
    if kind == "stress":
        touched = {r.id for r in state.nodes().where("map_contains_key(props, 'updated')").collect()}
        assert touched and touched <= {f"node-{i}" for i in range(4)}


def test_matrix_of_runs_is_summed_and_saved(spark, tmp_path):
    assert len(runner.matrix()) == 9 * 13
    runs = [r for r in runner.matrix([2], [20]) if r["kind"] == "write" or r["setting"] == 0.3]
    rows = {r.workload: r for r in runner.run_matrix(spark, str(tmp_path), runs).collect()}
    assert set(rows) == {"write-2-20", "mixed-0.3-2-20"} and rows["write-2-20"].ops == 20 and rows["mixed-0.3-2-20"].ops == 20
    assert all(r.p50 <= r.p95 <= r.p99 for r in rows.values())
    assert spark.read.json(str(tmp_path / "results/json")).count() == 2
