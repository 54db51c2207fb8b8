import random

import numpy as np
import xxhash

from graphloom.llm import simhash
from graphloom.llm.common import local_roots
from graphloom.llm.components import connected_components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_of_odd_texts():
    for t in (None, "", "  \t\n", "one", "One two THREE", "a b c d", "é É a b c d e", "x " * 5000, "a\x1cb c d e f", " ".join(map(str, range(400_000)))):
        assert simhash.fingerprint(t.encode() if t is not None else None) & (2**64 - 1) == brute_fp(t), repr(t)[:40]


def test_components_of_chains_stars_and_odd_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(rng.randint(300, 380), rng.randint(300, 380)) for _ in range(50)]
    df = spark.createDataFrame([*links, (5, 5), (None, 4), (9, None)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute_components(links, nodes)
    assert connected_components(df.where("a = -1")).count() == 0


def test_local_roots_match():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, 30), rng.integers(0, n, 30)
        want = brute_components(zip(a.tolist(), b.tolist(), strict=True), range(n))
        assert local_roots(n, a, b).tolist() == [want[i] for i in range(n)]


def check_links(spark, fps, **kw):
    reps = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc long, fp long")
    links = [(r.a, r.b) for r in simhash.near_links(reps, 4, **kw).collect()]
    true = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    nodes = range(len(fps))
    assert brute_components(links, nodes) == brute_components(true, nodes)


def test_links_connect_just_what_lies_near(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum({1 << rng.randrange(64) for _ in range(k)}) for b in base for k in (1, 3, 4, 5)]
    dense = [base[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)]
    fps = sorted({*base, *near, *dense, 0, 2**64 - 1})
    check_links(spark, fps)
    check_links(spark, fps, hot=40)  # crowded variants are split into cells


def test_near_duplicates_of_odd_rows(spark):
    rows = [(3, "a b c d e f"), (1, "A B C D E F"), (2, None), (9, ""), (4, "other words stand here now"), (4, "other words stand here now"), (None, "a b c d e f")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("3", 1), ("1", 1), ("2", 2), ("9", 2), ("4", 4), ("4", 4), ("None", 1)])
    assert simhash.near_duplicates(df.where("doc_id = -5")).count() == 0
