import random

import numpy as np

from graphloom.llm import toxicity


def brute_segments(s):
    """Maximal scoring segments by their definition: the best one, then the same on either side of it."""
    out = []

    def split(lo, hi):
        best = None
        for i in range(lo, hi):
            t = 0
            for j in range(i, hi):
                t += s[j]
                if t > 0 and (best is None or t > best[0] + 1e-12 or (abs(t - best[0]) <= 1e-12 and j - i < best[2] - best[1])):
                    best = (t, i, j)
        if best:
            split(lo, best[1])
            out.append((best[1], best[2], best[0]))
            split(best[2] + 1, hi)

    split(0, len(s))
    return out


def test_segments_equal_their_definition():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, -0.5, 1, 2, 3.25]) + rng.random() / 100 for _ in range(rng.randint(0, 25))]
        found = toxicity.Segments()
        for k in range(0, len(s), 7):
            found.add(np.array(s[k : k + 7]))
        got = found.all()
        want = brute_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_segments_take_linear_time():
    import time

    for scores in ([3.0, -0.1, *[-0.05] * 98], [1.0, -2.0], [2.0, -1.0], [1.0, -1.0, 1.5, -1.5]):
        found, began = toxicity.Segments(), time.perf_counter()
        many = np.tile(np.array(scores), 2_000_000 // len(scores))
        for part in np.array_split(many, 40):
            found.add(part)
        assert time.perf_counter() - began < 20 and found.n == len(many)


def brute_score(model, text):
    """The probability of a text by definition, from the model's numbers."""
    import math
    import re

    words = re.findall(r"[a-z]+", text.lower())
    score = []
    for w in words:
        known = [model.of[u] for u in [w, *(w[:n] + "-" for n in (8, 7, 6, 5, 4) if n < len(w))] if u in model.of]
        score.append(max(known, key=abs, default=0.0) - model.drift)
    base = model.log_k + math.log(max(len(words), 1))
    evidence = [model.rate * s - base for *_, s in brute_segments(score)]
    z = model.weights[0] + model.weights[1] * math.asinh(max(evidence, default=-base))
    z += model.weights[2] * math.log1p(sum(e for e in evidence if e > math.log(20)))
    return 1 / (1 + math.exp(-z))


def test_model_and_scores_equal_brute_force(spark):
    import math

    docs, labels = corpus(400)
    df, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lb)
    assert (model.scores < 0).any() and (model.scores > 0).any()
    half = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id) % 2 as h").collect()}
    import xxhash

    first = {}  # of texts with the same smallest shingle hash one counts
    for (i, text), (_, y) in zip(docs, labels, strict=True):
        w = text.split()
        first.setdefault((y, min(xxhash.xxh64_intdigest(" ".join(x)) for x in zip(w, w[1:], w[2:])) % 2**62), i)
    pairs = [(d, y) for d, (_, y) in zip(docs, labels, strict=True) if d[0] in set(first.values())]
    n = {}
    for (i, text), y in pairs:
        if half[i] == 0:
            for u in {u for w in set(text.split()) for u in [w, *(w[:k] + "-" for k in (8, 7, 6, 5, 4) if k < len(w))]}:
                n.setdefault(u, [0, 0])[y] += 1
    assert set(model.of) == set(n)
    t0, t1 = (sum(x[y] for x in n.values()) for y in (0, 1))
    for u, (a, b) in n.items():
        prior = 0.5 + 1000 * (a + b) / (t0 + t1)
        log = math.log((b + prior) / (t1 + 1000 - b - prior)) - math.log((a + prior) / (t0 + 1000 - a - prior))
        z = log / math.sqrt(1 / (a + prior) + 1 / (b + prior))
        assert math.isclose(model.of[u], log * z**8 / (z**8 + 3.5**8), abs_tol=1e-9)
    # The law: rate solves sum(share * exp(rate * score)) = 1 over clean words, log_k is the likeliest given it.
    clean = [t for (i, t), y in pairs if half[i] != 0 and y == 0]
    words = [round(100 * model.word(w)) / 100 for t in clean for w in t.split()]
    if max(words) > 0:
        assert abs(sum(math.exp(model.rate * s) for s in words) / len(words) - 1) < 1e-3
    else:  # no root
        assert model.rate == 1.0
    assert abs(0.75 * math.exp(-2 * (r := toxicity._rate(np.array([-2.0, 1.0]), np.array([0.75, 0.25])))) + 0.25 * math.exp(r) - 1) < 1e-6
    tops = [(len(t.split()), max((s for *_, s in brute_segments([model.word(w) for w in t.split()])), default=0.0)) for t in clean]
    assert math.isclose(model.log_k, math.log(len(tops)) - math.log(sum(k * math.exp(-model.rate * s) for k, s in tops)), rel_tol=1e-6)
    rows = spark.createDataFrame(docs[:60], "doc_id long, text string")
    for r in toxicity.score(rows, model, ["doc_id"]).collect():
        assert math.isclose(r.score, brute_score(model, docs[r.doc_id][1]), rel_tol=1e-6, abs_tol=1e-9)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).count() == 0


def corpus(n=300):
    rng = random.Random(1)
    words = [f"w{a}{b}" .replace("0", "a").replace("1", "b") for a in "abcdefgh" for b in "klmnop"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        if i % 5 == 0:
            for k in (10, 11, 40):
                text[k] = rng.choice(["vileword", "badstemx" + rng.choice("abcdefgh"), "nastyone"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    return docs, labels


def test_learns_and_places_passages(spark):
    docs, labels = corpus()
    df, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lb)
    held = [("clean " * 30, 0), ("waak wbbl vileword nastyone wack", 1), ("BADSTEMXzz### nastyone", 1), ("", 0), (None, 0), ("123 !!", 0)]
    rows = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(held)], "doc_id long, text string, passages string")
    got = {r.doc_id: r for r in toxicity.score(rows.select("doc_id", "text"), model, ["doc_id"]).collect()}
    assert [int(got[i].score >= 0.5) for i in range(len(held))] == [y for _, y in held]
    p = got[1].passages[0]
    assert held[1][0][p.start : p.end] == "vileword nastyone"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_passages_of_long_texts_have_right_places(spark, monkeypatch):
    model = toxicity.Model(["vile"], np.array([5.0]), 0.1, 1.0, -3.0, (0.0, 1.0, 1.0))
    text = "word " * 50 + "vile vile" + " word" * 50
    whole = model.score(text)
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    assert model.score(text) == whole
    assert [text[p["start"] : p["end"]] for p in whole[1]] == ["vile vile"]


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some words"), (1, "some words")], "doc_id long, text string")
    for labels in ([], [(1, None)], [(None, 1)], [(1, 0), (1, 0)]):
        model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score < 0.5 for r in toxicity.score(df, model, ["doc_id"]).collect()] == [True, True]
