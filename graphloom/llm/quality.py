"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, by language."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, load, materialize, ship

BEGIN, CHUNK, HELD, MOST_LANGS = 2, 1 << 20, 1 << 20, 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _symbols(text: str) -> np.ndarray:
    """Code points; digits count as one symbol, and the two codes below BEGIN as that above it."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
    x[(x >= 48) & (x <= 57)] = 48
    x[x <= BEGIN] = BEGIN + 1
    return x


def _windows(texts: list[str], order: int, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with `order` - 1 begin marks before each text, start of the n-gram that ends at each character, its hash)."""
    pad = np.full(order - 1, BEGIN, np.uint32)
    parts = [_symbols(t) for t in texts]
    x = np.concatenate([y for p in parts for y in (pad, p)]) if parts else pad
    sizes = np.array([len(p) for p in parts], np.int64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(parts)) * (order - 1), sizes)
    return x, at, _hash(x, at, order, lang)


def _hash(x: np.ndarray, at: np.ndarray, order: int, lang: str) -> np.ndarray:
    import xxhash

    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    key = np.full(max(len(x) - order + 1, 0), seed)
    for i in range(order):
        key = (key ^ x[i : len(x) - order + 1 + i].astype(np.uint64)) * MIX
        key ^= key >> np.uint64(29)
    return key[at]


def _strings(x: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    return np.ascontiguousarray(x[at[:, None] + np.arange(order)]).view(f"<U{order}").ravel() if len(at) else np.zeros(0, f"<U{order}")


def _reduced(keys, counts, grams):
    """One row a key, with the sum of its counts."""
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[by], first) if len(first) else counts[:0], grams(by[first])


def _cut(text: str, order: int):
    """(part, characters before it) of a text: parts of bounded length, each led by its left context."""
    for start in range(0, max(len(text), 1), CHUNK):
        before = min(start, order - 1)
        yield text[start - before : start + CHUNK], before


def _slices(rows: list[tuple], order: int):
    """Lists of (text, other, characters before it) of bounded size together; longer texts are cut."""
    part, size = [], 0
    for r in ((t, other, before) for text, other in rows for t, before in _cut(text, order)):
        part.append(r)
        size += len(r[0])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _gathered(order: int, ids=None):
    """Rows (lang, trusted, text) to (lang, g, n): every n-gram of the task's texts and its count in trusted ones.

    With ids, a broadcast of the trusted ids in order, the second column is the document's id instead."""

    def run(batches):
        held: dict[str, list] = {}
        known = None if ids is None else ids.value

        def flags(column):
            if known is None:
                return column.to_pylist()
            own = column.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            found = known[at] == own if len(known) else np.zeros(len(own), bool)
            return (found & column.is_valid().to_numpy(zero_copy_only=False)).tolist()

        def out(lang):
            keys, n, g = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.tolist(), pa.string()), pa.array(n, pa.int64())], names=["lang", "g", "n"])

        for batch in batches:
            by: dict[str, list] = {}
            for lang, trusted, text in zip(batch.column(0).to_pylist(), flags(batch.column(1)), batch.column(2), strict=True):
                by.setdefault(lang, []).append((text.as_py(), trusted))
            for lang, rows in by.items():
                for part in _slices(rows, order):
                    x, at, keys = _windows([t for t, *_ in part], order, lang)
                    own = np.repeat([bool(y) for _, y, _ in part], [len(t) for t, *_ in part]).astype(np.int64)
                    if any(before for *_, before in part):  # context is counted where it stands
                        new = np.concatenate([np.arange(len(t)) >= before for t, _, before in part])
                        at, keys, own = at[new], keys[new], own[new]
                    new = _reduced(keys, own, lambda i, x=x, at=at: _strings(x, at[i], order))
                    if lang in held:
                        both = [np.concatenate(y) for y in zip(held[lang], new, strict=True)]
                        new = _reduced(both[0], both[1], lambda i, g=both[2]: g[i])
                    held[lang] = list(new)
                    if len(new[0]) > HELD:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    return run


def model(docs: DataFrame, order: int = 5, ids=None) -> DataFrame:
    """(lang, g, logp) for every n-gram of docs (lang, trusted, text), seen in trusted text or not.

    With ids, a broadcast of the trusted ids in order, docs are (lang, id, text).

    p(w | context) of order n is (c - D(c)) / c(context) + gamma(context) p(w | shorter context), with the three
    discounts of each language and order from its counts of counts, true counts at the highest order and numbers of
    distinct left neighbours below it, and a uniform share over the seen symbols and one more at the end. Counts
    and contexts are joined by n-gram, so all work is spread by the hash of language and n-gram.
    """
    top = materialize(docs.mapInArrow(_gathered(order, ids), "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("c")), "grams")
    by_order = {order: top}
    for n in range(order - 1, 0, -1):
        shorter = by_order[n + 1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count_if(F.col("c") > 0).alias("c"))
        by_order[n] = materialize(shorter, f"grams{n}")
    logp, small = None, _small(by_order[1])
    for n in range(1, order + 1):
        rows, seen = by_order[n], by_order[n].where("c > 0")
        of = seen.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("v"))
        y = F.expr("n1 / greatest(n1 + 2 * n2, 1)")
        # Where counts of counts are missing, as in tiny texts, a discount is held between none and its count.
        hold = lambda e, most: F.least(F.greatest(e, F.lit(0.1)), F.lit(most))
        rate = lambda i: F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))
        discounts = small(of.select("lang", "v", hold(rate(1), 0.95).alias("d1"), hold(rate(2), 1.9).alias("d2"), hold(rate(3), 2.85).alias("d3")))
        context = F.substring("g", 1, n - 1) if n > 1 else F.lit("")
        d = F.expr("case when c = 1 then d1 when c = 2 then d2 else d3 end")
        stats = seen.join(discounts, "lang").groupBy("lang", context.alias("h")).agg(F.sum("c").alias("total"), F.sum(d).alias("lost"))
        at = rows.withColumn("h", context).join(stats, ["lang", "h"], "left").join(discounts, "lang", "left")
        own = F.coalesce(F.when(F.col("c") > 0, (F.col("c") - d) / F.col("total")), F.lit(0.0))
        gamma = F.coalesce(F.col("lost") / F.col("total"), F.lit(1.0))
        if n == 1:
            p = at.select("lang", "g", (own + gamma / (F.coalesce("v", F.lit(0)) + 1)).alias("p"))
        else:
            below = at.withColumn("s", F.substring("g", 2, n - 1)).join(logp.select("lang", F.col("g").alias("s"), F.col("p").alias("q")), ["lang", "s"])
            p = below.select("lang", "g", (own + gamma * F.col("q")).alias("p"))
        logp = materialize(p, f"p{n}") if n < order else p
    return materialize(logp.select("lang", "g", F.log("p").alias("logp")), "logp")


def _small(rows: DataFrame):
    """How to join tables of one row a language: broadcast, if rows hold no more than MOST_LANGS of them."""
    return F.broadcast if rows.select("lang").distinct().count() <= MOST_LANGS else (lambda df: df)


def _keyed(order: int):
    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            keys = np.zeros(batch.num_rows, np.uint64)
            if batch.num_rows:
                x = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), "<u4")
                own = np.array(langs)
                for lang in set(langs):
                    i = np.flatnonzero(own == lang)
                    keys[i] = _hash(x.reshape(-1, order)[i].ravel(), np.arange(len(i)) * order, order, lang)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(2).cast(pa.float32())], names=["key", "logp"])

    return run


def score(docs: DataFrame, logp: DataFrame, columns: list[str], order: int = 5, *, most: int = 6_000_000) -> DataFrame:
    """docs' `columns`, lang, n (characters) and nll (sum of negative log probabilities) for every row of docs (lang, text).

    Up to `most` n-grams (12 bytes each) the model goes to the tasks as a sorted array; a larger one is joined with
    the documents' n-gram counts by hash of language and n-gram. Both give the same sums but for rounding.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select("lang", "text", *columns)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    if logp.count() > most:

        def grams(batches):
            for batch in batches:
                for i, lang, piece, before in ((i, lang, *p) for i, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)) for p in _cut(text.as_py(), order)):
                    x, at, keys = (v if k == 0 else v[before:] for k, v in enumerate(_windows([piece], order, lang)))
                    _, n, g = _reduced(keys, np.ones(len(keys), np.int64), lambda j, x=x, at=at: _strings(x, at[j], order))
                    rows = np.full(len(g) + 1, i)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in [batch.column(0), *batch.columns[2:]]), pa.array([*g.tolist(), None], pa.string()), pa.array([*n.tolist(), 0], pa.int64())], names=["lang", *columns, "row", "g", "k"])

        columns = [*columns]
        numbered = source.withColumn("row", F.monotonically_increasing_id())
        spread = numbered.mapInArrow(grams, f"lang string, {kept + ', ' if kept else ''}row long, g string, k long")
        joined = spread.join(logp, ["lang", "g"], "left")
        return joined.groupBy("row", "lang", *columns).agg(F.sum("k").alias("n"), F.coalesce(F.sum(-F.col("k") * F.col("logp")), F.lit(0.0)).alias("nll")).drop("row")
    t = logp.mapInArrow(_keyed(order), "key long, logp float").toArrow()
    keys, values = t["key"].to_numpy().view(np.uint64), t["logp"].to_numpy()
    by = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[by], values[by]))
    del t, keys, values, by

    def run(batches):
        keys, values = sent.value
        for batch in batches:
            n, nll = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums, total, t = 0.0, 0, text.as_py()
                for piece, before in _cut(t, order):
                    _, _, own = _windows([piece], order, lang)
                    own = np.sort(own[before:])
                    sums -= float(values[np.searchsorted(keys, own)].sum(dtype=np.float64)) if len(own) else 0.0
                    total += len(own)
                n.append(total)
                nll.append(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array(n, pa.int64()), pa.array(nll, pa.float64())], names=[*columns, "lang", "n", "nll"])

    return source.mapInArrow(run, f"{kept + ', ' if kept else ''}lang string, n long, nll double")


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], *, order: int = 5, weight: int = 50, tail: float = 0.005, errors: float = 2.0, held: int = 5, most_ids: int = 8_000_000) -> DataFrame:
    """docs' `columns`, perplexity, low, high and kept for every row of docs (doc_id, lang, text).

    Trusted are the documents that labels (doc_id, quality) call 1 and never 0. One in `held` of them, by id hash, is
    kept out of the model, since its own text looks likelier to it than any other. A document's log perplexity is the
    mean over its characters, drawn to the mean of its language's kept-out ones as by `weight` characters of it, as
    few characters say little. It is kept if that lies between the quantile `tail` of all trusted documents of its
    language and the quantile 1 - `tail` of the kept-out ones: what is higher is unlike trusted text, what is lower is
    repetitive. The quantile of 1 / `tail` or more documents is widened by `errors` standard errors, from their number
    and standard deviation; fewer have no such quantile, so there it is a normal law's tolerance limit, as many standard
    errors out. Null lang is a language of its own; null text counts as empty; a language with fewer than four such
    documents on a side rejects nothing there.

    Up to `most_ids` trusted ids (8 bytes each) go to the counting tasks as a sorted array, so that no text is
    shuffled; more of them are joined. Scoring needs no labels: only its few columns meet them.
    """
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.min("quality") > 0, F.lit(False)).alias("trusted"))
    trusted = trusted.where("trusted").select(F.col("doc_id").cast("long").alias("_id_"), F.when(fold("doc_id", held) == 0, "out").otherwise("in").alias("part"))
    tidy = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("_doc_"), *columns)
    into = materialize(trusted, "trusted").where("part = 'in'").select("_id_")
    if into.count() <= most_ids:
        ids = np.sort(into.toArrow()["_id_"].to_numpy())
        logp = model(tidy.select("lang", "_doc_", "text"), order, docs.sparkSession.sparkContext.broadcast(ids))
    else:
        marked = tidy.select("lang", "_doc_", "text").join(into, F.col("_doc_") == F.col("_id_"), "left")
        logp = model(marked.select("lang", F.col("_id_").isNotNull().alias("trusted"), "text"), order)
    scores = score(tidy, logp, [*columns, "_doc_"], order)
    found = materialize(scores.join(trusted, F.col("_doc_") == F.col("_id_"), "left").drop("_id_", "_doc_"), "scores")
    means = found.where("part = 'out'").groupBy("lang").agg((F.sum("nll") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    small = _small(found)
    with_mean = found.join(small(means), "lang", "left")
    x = with_mean.withColumn("x", F.coalesce((F.col("nll") + weight * F.col("mean")) / (F.col("n") + weight), F.col("nll") / F.greatest("n", F.lit(1))))
    z = NormalDist().inv_cdf(1 - tail)
    n, spread = F.count("x"), F.stddev_samp("x")
    # Natrella's approximation of a tolerance factor; with too few documents there is none.
    a, b = 1 - errors**2 / (2 * F.nullif(n - 1, F.lit(0))), z * z - errors**2 / n
    factor = F.when(a > 0, (z + F.sqrt(z * z - a * b)) / a)
    own = lambda p, sign: F.when(n * tail >= 1, F.percentile_approx("x", p, 10_000) + sign * errors * spread * F.sqrt((1 + z * z / 2) / n)).otherwise(F.avg("x") + sign * factor * spread)
    q = lambda rows, p, sign, to: rows.groupBy("lang").agg(own(p, sign).alias(to))
    done = x.join(small(q(x.where("part is not null"), tail, -1, "low")), "lang", "left").join(small(q(x.where("part = 'out'"), 1 - tail, 1, "high")), "lang", "left")
    done = done.withColumn("perplexity", F.exp("x")).withColumn("low", F.exp("low")).withColumn("high", F.exp("high"))
    inside = F.coalesce(F.col("perplexity") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("perplexity") <= F.col("high"), F.lit(True))
    return done.select(*columns, "perplexity", "low", "high", inside.alias("kept"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])
