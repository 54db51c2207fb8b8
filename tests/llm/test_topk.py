import math

import numpy as np

from graphloom.llm.topk import quantize, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, query_id string, rank int"


def brute(rows, queries, k):
    q = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    good = {(i, tuple(q(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out, of = set(), {}
    for qi, qv in good:
        if qi not in queries:
            continue
        best = of.setdefault(qi, {})
        for ci, cv in good:
            if ci != qi and len(cv) == len(qv):
                best[ci] = max(best.get(ci, -(10**30)), sum(a * b for a, b in zip(qv, cv, strict=True)))
    for qi, best in of.items():
        for r, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k], 1):
            out.add((qi, r, i, -s))
    return out


def run(spark, rows, queries, k=3, **kw):
    df = spark.createDataFrame([(i, v, 1, "x", 9) for i, v in rows], SCHEMA)
    q = quantize(df, "embedding", 256.0)
    return {tuple(r) for r in top_k(q, q.where(q.vec_id.isin(*queries)), k, **kw).collect()}


def test_equals_brute_force_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(30)]
    for block in (16, 4096):
        assert run(spark, rows, {0, 5, 50}, block=block, query_block=2) == brute(rows, {0, 5, 50}, 3)
        assert run(spark, rows, {0, 5, 50}, block=block, parts=3) == brute(rows, {0, 5, 50}, 3)


def test_odd_rows(spark):
    rows = [(0, [0.5, 0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [0.1, 0.2]), (5, [0.1, 0.2]), (6, [1.0]), (7, []), (8, [])]
    more = [(0, [-0.5, 3.0]), (0, [2.0, -0.25]), *rows]
    assert run(spark, more, {0, 5}, k=3) == brute(more, {0, 5}, 3)
    got = run(spark, rows, {0, 6, 7}, k=5)
    assert got == brute(rows, {0, 6, 7}, 5)
    assert {x[0] for x in got} == {0, 7}


def test_empty_and_too_few(spark):
    assert run(spark, [], {0}) == set()
    assert run(spark, [(0, [1.0])], {0}) == set()


def test_registered_query_equals_its_sql(spark):
    import duckdb

    from graphloom.llm.registry import oracle_sql, queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, d)
        rel = con.execute(sql)
        names = [c[0] for c in rel.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall()), key=str)
        assert sorted((tuple(r) for r in df.collect()), key=str) == want
