import numpy as np
import pandas as pd
import pytest

from graphloom.llm.embed_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, component_id string"


def brute(rows):
    links = {k: set() for k in range(len(rows))}
    unit = []
    for i, v, label in rows:
        x = None
        if i is not None and label is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            x = x / np.linalg.norm(x)
        unit.append(x)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a].add(b)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[b][0] for b in seen]
        own = rows[a][0] if None in ids else min(ids)
        out.append((rows[a][0], len(links[a]), own, own == rows[a][0]))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in near_duplicates(df, **kw).collect()), key=str)


def test_groups_larger_than_the_window_are_counted_exactly(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, (rng.standard_normal(16)).tolist(), i % 2) for i in range(100)]
    rows += [(100 + i, (centre + 0.05 * rng.standard_normal(16)).tolist(), 0) for i in range(90)]
    rows += [(300 + i, rows[0][1], 0) for i in range(20)] + [(400, rows[0][1], 1)]
    assert run(spark, rows, window=8) == brute(rows)


def test_odd_rows(spark):
    same = [0.5, 0.25]
    rows = [(1, same, 0), (2, same, 0), (2, same, 0), (3, same, None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [None, 1.0], 0), (7, [float("nan"), 1.0], 0), (8, [], 0), (9, [0.5, 0.25, 0.0], 0), (10, [1e-30, 0.0], 1), (11, [1e30, 0.0], 1), (None, same, 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def recall(spark, n, dim, pairs, mean, cosine, **kw):
    """The share of planted pairs of that cosine found among n vectors of that mean cosine."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(dim))
    x = unit(np.sqrt(mean) * centre + np.sqrt(1 - mean) * unit(rng.standard_normal((n, dim))))
    # A neighbour lies in the same cloud: its step leaves the share of the centre as it is.
    own = unit(x[:pairs] - (x[:pairs] @ centre)[:, None] * centre)
    step = rng.standard_normal((pairs, dim))
    step -= (step @ centre)[:, None] * centre
    step = unit(step - (step * own).sum(axis=1, keepdims=True) * own)
    height = x[:pairs] @ centre
    inner = (cosine - height**2) / (1 - height**2)
    new = height[:, None] * centre + np.sqrt(1 - height**2)[:, None] * (inner[:, None] * own + np.sqrt(1 - inner**2)[:, None] * step)
    x = np.concatenate([x, new]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "label": 0}), "vec_id long, embedding array<float>, label int")
    root = {r.vec_id: r.component_id for r in near_duplicates(df, **kw).collect()}
    return sum(root[i] == root[n + i] for i in range(pairs)) / pairs


@pytest.mark.parametrize("mean", [0.0, 0.9, 0.95])
def test_recall_in_labels_of_one_direction(spark, mean):
    assert recall(spark, 20_000, 64, 500, mean, 0.982) >= 0.9


def test_neighbours_over_the_border_of_a_range_meet(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        # One pass and ranges of about a hundred rows: most pairs would be cut apart at some border or other.
        assert recall(spark, 2000, 8, 400, 0.0, 0.99999, window=50, passes=1) >= 0.9
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
