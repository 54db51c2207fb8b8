import random

import numpy as np
import pytest

from graphloom.llm import shingles
from graphloom.llm.common import local_roots

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def jaccard(a, b):
    x, y = (set(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def test_edited_copies_go_and_other_texts_stay(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(120, 400))) for _ in range(40)]
    docs = list(enumerate(base)) + [(100 + i, edited(rng, t, len(t.split()) // 60)) for i, t in enumerate(base)] + [(200 + i, edited(rng, t, len(t.split()) // 12)) for i, t in enumerate(base)]
    docs += [(300 + i, edited(rng, base[0], 1)) for i in range(80)]  # a group larger than a bucket's window
    alike = {i for i, t in docs for j, u in docs if j < i and jaccard(t, u) >= 0.8}
    assert sum(100 <= i < 200 for i in alike) >= 38 and not any(200 <= i < 300 for i in alike)
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i, _ in docs} - alike


def test_blocks_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    for across in (False, True):
        base = [rng.choice(4000, 60, replace=False) for _ in range(12)]
        sets = [np.unique(np.concatenate([b[: 60 - k], rng.integers(5000, 9000, k)])) for b in base for k in rng.integers(0, 12, 10)]
        root, part = rng.integers(0, 40, len(sets)), rng.integers(0, 2, len(sets))
        alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
        n = range(len(sets))
        want = [(i, j) for i in n for j in range(i) if root[i] != root[j] and (not across or part[i] != part[j]) and alike(sets[i], sets[j])]
        got = shingles.block_links(np.arange(len(sets)), root, part, sets, 0.8, across)
        assert want and {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in want}
        joined = lambda links: local_roots(40, *(root[[p[k] for p in links]] for k in (0, 1))).tolist()
        assert joined(got) == joined(want)


@pytest.mark.parametrize("part", [1 << 18, 1500])
def test_large_buckets_of_many_groups_lose_no_link(spark, monkeypatch, part):
    # One band of one row puts all texts of a common frame in one bucket; most are unlike its smallest.
    monkeypatch.setattr(shingles, "PART", part)
    rng = random.Random(3)
    frame = [f"f{i}" for i in range(60)]
    groups = [[f"g{g}.{i}" for i in range(rng.randint(60, 300))] for g in range(30)]
    docs = [(10 * g + k, " ".join(frame + words + [f"t{g}.{k}"] * k)) for g, words in enumerate(groups) for k in range(3)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    root = {i: i for i, _ in docs}
    for i, t in sorted(docs):
        for j, u in docs:
            if j < i and jaccard(t, u) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {d: low if r == high else r for d, r in root.items()}
    want = set(root.items())
    got = {(r.doc_id, r.component_id) for r in shingles.similar(df, bands=200, rows=1).collect()}
    assert got == want and len({r for _, r in want}) > 20


def test_odd_rows(spark):
    rows = [(3, "a b c d e f"), (1, "A B C D E F"), (2, None), (9, ""), (4, "one"), (4, "one"), (None, "a b c d e f"), (None, "alone here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((str(r.doc_id), r.component_id) for r in shingles.similar(df).collect()), key=str)
    assert [x for x in got if x[0] != "None"] == [("1", 1), ("2", 2), ("3", 1), ("4", 4), ("4", 4), ("9", 2)]
    assert shingles.similar(df.where("doc_id = -5")).count() == 0
