import re

from graphloom.llm import langid

EN = "the cat and the dog are with this house that is for them".split()
DE = "der hund und die katze sind mit dem haus das ist nicht für sie".split()


def rows(n=40):
    return [(i, " ".join((EN if i % 2 else DE)[(i + k) % 12] for k in range(9)), "en" if i % 2 else "de") for i in range(n)]


def fit(spark, data, **kw):
    return langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), **kw)


def brute_counts(data, longest=4):
    from collections import Counter

    out = Counter()
    for _, text, lang in data:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            out["w", w, lang] += 1
            m = f" {w} "
            for n in range(1, longest + 1):
                for i in range(len(m) - n + 1):
                    out[str(n), m[i : i + n], lang] += 1
    return out


def test_model_equals_brute_force_frequencies(spark):
    import numpy as np

    data = rows()
    model, counts = fit(spark, data), brute_counts(data)
    of = {}
    for (kind, u, lang), n in counts.items():
        of.setdefault((kind, u), {})[lang] = n
    assert set(model.words) == {u for k, u in of if k == "w"}
    total = {lang: sum(v.get(lang, 0) for (k, _), v in of.items() if k == "w") for lang in ("de", "en")}
    n = sum(k == "w" for k, _ in of)
    for (k, u), v in of.items():
        if k == "w":
            want = [np.log((v.get(x, 0) + 0.1) / (total[x] + 0.1 * n)) for x in ("de", "en")]
            assert np.allclose(model.logs[model.words[u]], want, atol=1e-4)


def test_predictions_and_odd_texts(spark):
    model = fit(spark, rows())
    assert model.predict("the DOG is with them")[0] == "en"
    assert model.predict("katzenhaus hunde")[0] == "de"  # unseen words, by n-grams
    for t in (None, "", "123 %%% _", " \n"):
        assert model.predict(t) == ("und", 0.0)
    long = model.predict("der hund " * 100_000)
    assert long[0] == "de" and 0.5 < long[1] <= 1
    df = spark.createDataFrame([(1, None, "q", "x"), (1, "the cat", None, "y"), (None, "der hund", "z", "w")], "doc_id long, text string, lang_pred string, score string")
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(df.select("doc_id", "text"), model, ["doc_id"]).collect()}
    assert got == {(1, "und"), (1, "en"), (None, "de")}


def brute_predict(data, text, longest=4):
    """(language, score) from the texts by definition."""
    import math

    counts, langs = brute_counts(data, longest), sorted({x for *_, x in data})
    kinds = {k: sorted({u for kind, u, _ in counts if kind == k}) for k in ("w", *map(str, range(1, longest + 1)))}
    log = {}
    for k, names in kinds.items():
        for x in langs:
            total = sum(counts[k, u, x] for u in names)
            for u in names:
                log[k, u, x] = math.log((counts[k, u, x] + 0.1) / (total + 0.1 * len(names)))
    floor = {x: min(v for (*_, y), v in log.items() if y == x) - 1 for x in langs}

    def word(w, x):
        if ("w", w, x) in log:
            return log["w", w, x]
        for n in range(min(longest, len(w) + 2), 0, -1):
            grams = [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
            if any((str(n), g, x) in log for g in grams):
                return sum(log.get((str(n), g, x), floor[x]) for g in grams) / len(grams)
        return floor[x]

    words = re.findall(r"[^\W\d_]+", text.lower())
    mean = {x: sum(word(w, x) for w in words) / len(words) for x in langs}
    best = max(langs, key=lambda x: mean[x])
    return best, 1 / sum(math.exp(v - mean[best]) for v in mean.values())


def test_predictions_equal_brute_force(spark):
    import random

    data, rng = [*rows(), (90, "una casa y otra casa", "es")], random.Random(4)
    model = fit(spark, data)
    for _ in range(200):
        text = " ".join(rng.choice([*EN, *DE, "casa", "otrasX", "qq", "thehaus", "zzz", "ø", "it"]) for _ in range(rng.randint(1, 12)))
        want = brute_predict(data, text)
        got = model.predict(text)
        assert abs(got[1] - want[1]) < 1e-4 and (got[0] == want[0] or want[1] < 0.51)


def test_letters_marks_and_numerals(spark):
    model = fit(spark, [*rows(), (91, "हिन्दी में लिखा", "hi"), (92, "e\u0301te\u0301", "fr")])
    for text in ("½ ² Ⅷ ①", "\u0301\u0302", "12 ३४ _"):
        assert model.predict(text) == ("und", 0.0)
    assert {"हिन्दी", "e\u0301te\u0301"} <= set(model.words)
    assert model.predict("हिन्दी ½")[0] == "hi"


def test_empty_table(spark):
    model = fit(spark, [])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert langid.predict(df, model, ["doc_id"]).count() == 0


def test_the_cache_starts_anew(monkeypatch):
    import numpy as np

    monkeypatch.setattr(langid, "CACHE", 3)
    logs = np.log(np.array([[0.9, 0.1], [0.2, 0.8]], np.float32))
    small = langid.Model(["a", "b"], 2, [("w", "x"), ("1", "y")], logs)
    text = "x " + " ".join("y" * k for k in range(2, 12))
    monkeypatch.setattr(langid, "CACHE", 1000)
    assert small.predict(text) == langid.Model(["a", "b"], 2, [("w", "x"), ("1", "y")], logs).predict(text)


def test_nothing_to_learn_from(spark):
    model = fit(spark, [(1, None, "en"), (2, "words", None)])
    assert model.predict("words") == ("und", 0.0)
    df = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert [tuple(r) for r in langid.predict(df, model, ["doc_id"]).collect()] == [(1, "und", 0.0)]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in langid.op6_language_id(spark, d).collect()}
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == len(true) and held
    assert sum(got[i].lang_pred == true[i] for i in held) >= 0.95 * len(held)


def test_a_model_takes_little_memory():
    import pickle
    import tracemalloc

    import numpy as np

    units = [("w", f"word{i}") for i in range(200_000)] + [("4", f"g{i}") for i in range(1000)]
    sent = pickle.dumps(langid.Model(["a", "b"], 4, units, np.zeros((len(units), 2), np.float32)))
    tracemalloc.start()
    own = pickle.loads(sent)
    assert own.predict("word word") == ("a", 0.5)
    assert tracemalloc.get_traced_memory()[0] < 60 * len(units)
    tracemalloc.stop()
    assert [own.words[f"word{i}"] for i in (0, 7, 199_999)] == [0, 7, 199_999] and own.grams["g5"] == 200_005


def test_units_of_equal_hash_are_told_apart(monkeypatch):
    names = ["a", "bb", "", "ccc", "हि", "dd"]
    for hash_ in (None, lambda data: 7):
        if hash_:
            monkeypatch.setattr(langid.xxhash, "xxh3_64_intdigest", hash_)
        units = langid.Units(names, [9, 8, 7, 6, 5, 4])
        assert units.find([*names, "b", "cc", "a"]) == [9, 8, 7, 6, 5, 4, None, None, 9]
        assert sorted(units) == sorted(names) and units["dd"] == 4 and units.get("x") is None


def held_by_workers(spark, kind):
    """Objects of a class of this package in the Python workers, counted by tasks that need none."""

    def run(batches):
        import gc

        import pyarrow as pa

        n = sum(type(x).__name__ == kind and type(x).__module__.startswith("graphloom.") for x in gc.get_objects())
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return sum(r.n for r in spark.range(0, 8, 1, 8).mapInArrow(run, "n long").collect())


def test_workers_let_go_of_the_model(spark):
    model = fit(spark, rows())
    df = spark.createDataFrame([(i, "the cat") for i in range(80)], "doc_id long, text string").repartition(8)
    assert langid.predict(df, model, ["doc_id"]).where("lang_pred = 'en'").count() == 80
    assert held_by_workers(spark, "Model") == 0
