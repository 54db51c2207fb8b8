"""Toxicity: every maximum-scoring segment of token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, fold, load, materialize, ship

CHUNK, CACHE = 1 << 20, 200_000
PREFIXES = (8, 7, 6, 5, 4)
BREAK = regex.compile(r"[^\p{L}\p{M}]")


def pieces(text: str):
    """(offset, piece) of bounded length, cut between words."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > CHUNK:
            found = BREAK.search(text, start + CHUNK)
            end = found.start() if found else end
        yield start, text[start:end]
        start = end


class Segments:
    """All maximal scoring segments of a stream of scores, in linear time; each is (first, last, score).

    `open` holds segments that a later one may still take in: (first, last, sum before, sum at the end, place of the
    nearest earlier one with a smaller sum before). The search for such a one follows these places, so it passes by each
    segment once; where it finds none, all that stand are final and leave the list.
    """

    def __init__(self):
        self.total, self.n, self.open, self.done = 0.0, 0, [], []

    def add(self, scores: np.ndarray) -> None:
        sums = np.cumsum(scores) + self.total
        open_ = self.open
        at = np.flatnonzero(scores > 0)
        lefts = np.where(at > 0, sums[at - 1], self.total).tolist() if len(at) else []
        for i, left, right in zip((self.n + at).tolist(), lefts, sums[at].tolist(), strict=True):
            first, j = i, len(open_) - 1
            while True:
                while j >= 0 and open_[j][2] >= left:
                    j = open_[j][4]
                if j < 0:
                    self.done += open_
                    open_.clear()
                    break
                if open_[j][3] >= right:
                    break
                first, _, left, _, before = open_[j]
                del open_[j:]
                j = before
            open_.append((first, i, left, right, j))
        if len(scores):
            self.total = float(sums[-1])
        self.n += len(scores)

    def all(self) -> list[tuple[int, int, float]]:
        return [(a, b, high - low) for a, b, low, high, _ in (*self.done, *self.open)]


def units(word: str) -> list[str]:
    """A word and its prefixes, which stand for stems that compounds share, longest first."""
    return [word, *(word[:n] + "-" for n in PREFIXES if n < len(word))]


class Model:
    """Scores of words and prefixes, the extreme-value law of the best segment of clean text, and the weights that join evidence."""

    def __init__(self, words: list[str], scores: np.ndarray, drift: float, rate: float = 1.0, log_k: float = 0.0, weights=(0.0, 0.0, 0.0)):
        self.words, self.scores, self.drift = words, scores, drift
        self.rate, self.log_k, self.weights = rate, log_k, weights
        self.of = dict(zip(words, map(float, scores), strict=True))
        self.seen: dict[str, float] = {}

    def word(self, w: str) -> float:
        """The score farthest from none of a word's units, less the drift."""
        if len(self.seen) > CACHE:
            self.seen = {}
        found = [self.of[u] for u in units(w) if u in self.of]
        self.seen[w] = out = max(found, key=abs, default=0.0) - self.drift
        return out

    def tokens(self, text: str | None):
        """The scores of a text's words, in arrays of bounded length."""
        for _, piece in pieces(text or ""):
            yield np.array([self.seen.get(w) or self.word(w) for w in WORD.findall(piece.lower())], float)

    def segments(self, text: str | None) -> Segments:
        out = Segments()
        for scores in self.tokens(text):
            out.add(scores)
        return out

    def features(self, found: Segments) -> tuple[float, float, list[tuple[int, int, float]]]:
        """(evidence of the best segment, evidence of all significant ones, these): nats beyond what chance gives a text
        of this length, the first two on a scale that grows with their logarithm."""
        base = self.log_k + np.log(max(found.n, 1))
        seen = [(a, b, self.rate * s - base) for a, b, s in found.all()]
        strong = [x for x in seen if x[2] > SIGNIFICANT]
        return float(np.arcsinh(max((e for *_, e in seen), default=-base))), float(np.log1p(sum(e for *_, e in strong))), strong

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """(probability, significant passages with their places in the text)."""
        found = self.segments(text)
        best, total, strong = self.features(found)
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * total
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))), self._places(text, strong)

    def _places(self, text: str | None, strong) -> list[dict]:
        if not strong:
            return []
        need, at, n = {i for a, b, _ in strong for i in (a, b)}, {}, 0
        for offset, piece in pieces(text):
            for m in WORD.finditer(piece):
                if n in need:
                    at[n] = offset + m.start(), offset + m.end()
                n += 1
        return [{"start": at[a][0], "end": at[b][1], "evidence": e} for a, b, e in strong]


SIGNIFICANT = float(np.log(20))  # an expected count by chance of 1 in 20


def _sketched(batches):
    """The smallest hash of a text's 3-word shingles: copies and near-copies mostly agree on it."""
    for batch in batches:
        least = []
        for text in batch.column(1):
            of = 1 << 64
            for _, piece in pieces(text.as_py() or ""):
                w = WORD.findall(piece.lower())
                of = min(of, min((xxhash.xxh64_intdigest(" ".join(x)) for x in (zip(w, w[1:], w[2:], strict=False) if len(w) > 2 else [w])), default=of))
            least.append(of % (1 << 62))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.int64())], names=["doc_id", "sketch"])


def _counted(batches):
    """In how many documents of either label each unit stands."""
    n: dict[tuple[str, int], int] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.string()), pa.array([t for _, t in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["word", "toxic", "n"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = {w for _, piece in pieces(text.as_py() or "") for w in WORD.findall(piece.lower())}
            for u in {u for w in words for u in units(w)}:
                n[u, toxic] = n.get((u, toxic), 0) + 1
            if len(n) > 400_000:
                yield out()
                n = {}
    yield out()


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1, for scores of negative mean."""
    if (scores * shares).sum() >= 0 or scores.max(initial=0) <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (shares * np.exp(high * scores)).sum() < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w * ([1e-6] + [1.0] * (len(w) - 1)))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 8000, prior: float = 1000.0, doubt: float = 3.5, drift: float = 0.05) -> Model:
    """A model from docs (doc_id, text) with labels (doc_id, toxic); several labels of a document count as toxic if one is.

    Bound: of each class the labelled documents of smallest id hash are read, `per_class` of them but for the hash's
    spread. One half of that sample gives the token counts; the other half, which the counts have not seen, gives the
    extreme-value law and the weights. Every word and prefix of the first half has a score, its log-odds under the
    Dirichlet prior, above or below none; those that lie fewer than `doubt` standard errors from none
    shrink towards it, the more so the nearer.
    """
    spark = docs.sparkSession
    ship(spark)
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    own = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = own.groupBy("toxic").count().collect()
    if not sizes:
        return Model([], np.zeros(0), drift, weights=(-30.0, 0.0, 0.0))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["toxic"], min(1.0, per_class / r["count"]))])
    sample = own.where(F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1)) <= share[F.col("toxic")] * F.lit(float(2**63)))
    # About 2 * per_class ids at most, each once, so they are safe to broadcast.
    texts = materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "labelled")
    # A passage that stands in many copies of a document is no evidence of many: copies count once.
    sketches = texts.select("doc_id", "text").mapInArrow(_sketched, "doc_id long, sketch long")
    apart = sample.join(sketches, "doc_id").groupBy("toxic", "sketch").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"))
    texts = texts.join(F.broadcast(materialize(apart, "sample")), "doc_id")
    counts = texts.where("half = 0").select("toxic", "text").mapInArrow(_counted, "word string, toxic int, n long")
    t = counts.groupBy("word").agg(*[F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(f"n{t}") for t in (0, 1)]).orderBy("word").toArrow()
    n0, n1 = (t[c].to_numpy().astype(float) for c in ("n0", "n1"))
    total0, total1 = n0.sum(), n1.sum()
    a = 0.5 + prior * (n0 + n1) / max(total0 + total1, 1)
    odds = lambda n, total: np.log((n + a) / (total + prior - n - a))
    delta = odds(n1, total1) - odds(n0, total0)
    z2 = delta**2 / (1 / (n1 + a) + 1 / (n0 + a))
    model = Model(t["word"].to_pylist(), delta * z2**4 / (z2**4 + doubt**8), drift)
    other = texts.where("half = 1").select("toxic", "text")

    # The law of clean text, first its rate by how often each score, in hundredths, comes.
    sent = spark.sparkContext.broadcast(_packed(model))

    def scored(batches):
        m, seen = _unpacked(sent.value), Counter()
        for batch in batches:
            for x in batch.column(1):
                for scores in m.tokens(x.as_py()):
                    at, n = np.unique(np.rint(100 * scores).astype(np.int64), return_counts=True)
                    seen.update(dict(zip(at.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])

    # Log-odds have no more than a few thousand hundredths.
    hist = other.where("toxic = 0").mapInArrow(scored, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    s, n = np.array([r["s"] for r in hist], float) / 100, np.array([r["n"] for r in hist], float)
    model.rate = _rate(s, n / max(n.sum(), 1))

    def best(batches):
        m = _unpacked(sent.value)
        for batch in batches:
            found = [m.segments(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([max(f.n, 1) for f in found], pa.int64()), pa.array([max((s for *_, s in f.all()), default=0.0) for f in found], pa.float64())], names=["n", "top"])

    # Here and below one row of numbers a document of the sample.
    rows = other.where("toxic = 0").mapInArrow(best, "n long, top double").collect()
    if rows:
        own_n, own_top = np.array([r["n"] for r in rows], float), np.array([r["top"] for r in rows])
        model.log_k = float(np.log(len(rows)) - np.log((own_n * np.exp(-model.rate * own_top)).sum()))
    law = spark.sparkContext.broadcast((model.rate, model.log_k))

    def evidence(batches):
        m = _unpacked(sent.value)
        m.rate, m.log_k = law.value
        for batch in batches:
            found = [m.features(m.segments(x.as_py()))[:2] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], pa.float64()) for i in (0, 1))], names=["toxic", "best", "every"])

    rows = other.mapInArrow(evidence, "toxic int, best double, every double").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if len(set(y)) == 2:
        model.weights = tuple(float(w) for w in _logistic(np.array([(r["best"], r["every"]) for r in rows]), y))
    else:
        model.weights = ((30.0 if len(y) and y[0] else -30.0), 0.0, 0.0)
    return model


def _packed(m: Model):
    return "\0".join(m.words), m.scores, m.drift, m.rate, m.log_k, m.weights


def _unpacked(x) -> Model:
    return Model(x[0].split("\0") if x[0] else [], *x[1:])


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """docs' `columns`, score and passages for every row; null and empty texts get the score of no evidence. An empty
    table gives no rows, and a text of any length takes time linear in it.

    passages: array of (start, end, evidence), each a significant segment by its characters.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(_packed(model))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def run(batches):
        m = _unpacked(sent.value)
        for batch in batches:
            found = [m.score(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([s for s, _ in found], pa.float64()), pa.array([p for _, p in found], kind)], names=[*columns, "score", "passages"])

    source = docs.select(F.col("text").alias("_text_"), *columns)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]), "score double, passages array<struct<start:long,end:long,evidence:double>>"])
    return source.mapInArrow(run, shape)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 5) == 0)
    model = train(docs.where(~F.col("held_out")), load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = score(docs, model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
