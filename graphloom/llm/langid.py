"""Language identification: known words first, then ever shorter character n-grams for unseen words."""

from __future__ import annotations

from collections import Counter
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, fold, load, ship

UNKNOWN = "und"
CACHE, FLUSH, PART = 100_000, 50_000, 1 << 12


def _grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _units(longest: int):
    """Counts of the words ('w') and character n-grams ('1', '2', ...) of a task's texts, by language."""

    def run(batches):
        words: dict[str, Counter] = {}

        def out():
            for lang, of in words.items():
                for n in range(longest + 1):
                    units = of if n == 0 else Counter()
                    for w, c in of.items() if n else ():
                        for g in _grams(w, n):
                            units[g] += c
                    same = lambda x, k=len(units): pa.array([x] * k, pa.string())
                    yield pa.RecordBatch.from_arrays([same(lang), same(str(n or "w")), pa.array(list(units), pa.string()), pa.array(list(units.values()), pa.int64())], names=["lang", "kind", "unit", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words.setdefault(lang, Counter()).update(m[0] for m in WORD.finditer(text.as_py().lower()))
                if sum(map(len, words.values())) > FLUSH:
                    yield from out()
                    words = {}
        yield from out()

    return run


class Units:
    """Row numbers of strings, held as arrays: about a sixth of what a dict of them takes. Equal hashes are told apart by the strings."""

    def __init__(self, names: list[str], rows: list[int]):
        found = [x.encode() for x in names]
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
        by = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[by], np.array(rows, np.int32)[by]
        self.starts = np.concatenate([[0], np.cumsum([len(found[i]) for i in by], dtype=np.int64)])
        self.joined = b"".join([found[i] for i in by])

    def get(self, name: str) -> int | None:
        own = name.encode()
        key = np.uint64(xxhash.xxh3_64_intdigest(own))
        for i in range(self.keys.searchsorted(key), self.keys.searchsorted(key, "right")):
            if self.joined[self.starts[i] : self.starts[i + 1]] == own:
                return int(self.rows[i])
        return None

    def find(self, names: list[str]) -> list[int | None]:
        """get() of each name."""
        if not (len(self) and names):
            return [None] * len(names)
        found = [x.encode() for x in names]
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
        i = np.minimum(self.keys.searchsorted(keys), len(self) - 1)
        each = zip(names, found, (self.keys[i] == keys).tolist(), self.starts[i].tolist(), self.starts[i + 1].tolist(), self.rows[i].tolist(), strict=True)
        return [(row if self.joined[a:b] == own else self.get(name)) if same else None for name, own, same, a, b, row in each]

    def __getitem__(self, name: str) -> int:
        if (i := self.get(name)) is None:
            raise KeyError(name)
        return i

    def __iter__(self):
        return (self.joined[a:b].decode() for a, b in pairwise(self.starts.tolist()))

    def __len__(self) -> int:
        return len(self.keys)


class Model:
    """Log relative frequencies of words and n-grams by language. It is pickled without what it remembers of texts."""

    def __init__(self, langs: list[str], longest: int, units: list[tuple[str, str]], logs: np.ndarray):
        words, grams = ([i for i, (k, _) in enumerate(units) if (k == "w") == own] for own in (True, False))
        self.__setstate__((langs, longest, *(Units([units[i][1] for i in of], of) for of in (words, grams)), logs))

    def __getstate__(self):
        return self.langs, self.longest, self.words, self.grams, self.logs

    def __setstate__(self, state) -> None:
        self.langs, self.longest, self.words, self.grams, logs = state
        self.absent = logs.min(axis=0) - 1.0 if len(logs) else np.zeros(len(self.langs), np.float32)
        self.rows = np.concatenate([logs, np.zeros((CACHE, len(self.langs)), np.float32)])
        self.logs = self.rows[: len(logs)]
        self._clear()

    def _clear(self) -> None:
        self.place, self.size, self.most = {}, len(self.logs), len(self.rows) - len(self.logs)

    def _take_in(self, part: list[str]) -> None:
        """Gives each of at most `most` words a place, and unseen ones a row."""
        new = [w for w in dict.fromkeys(part) if w not in self.place]
        if len(self.place) + len(new) > self.most:
            self._clear()
            new = list(dict.fromkeys(part))
        found = dict(zip(new, self.words.find(new), strict=True))
        unseen = [w for w, at in found.items() if at is None]
        self.rows[self.size : self.size + len(unseen)] = self._unseen(unseen)
        found.update(zip(unseen, range(self.size, self.size + len(unseen)), strict=True))
        self.size += len(unseen)
        self.place.update(found)

    def _unseen(self, words: list[str]) -> np.ndarray:
        out, left = np.tile(self.absent, (len(words), 1)), list(range(len(words)))
        # The longest n-grams of which the model knows any decide; those it doesn't know there count as absent.
        for n in range(self.longest, 0, -1):
            grams = [_grams(words[i], n) for i in left]
            found, still = iter(self.grams.find([g for of in grams for g in of])), []
            for i, of in zip(left, grams, strict=True):
                known = [at for at in islice(found, len(of)) if at is not None]
                if known:
                    out[i] = (self.logs[known].sum(axis=0) + (len(of) - len(known)) * self.absent) / len(of)
                else:
                    still.append(i)
            left = still
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of it in the softmax over the mean scores of the words)."""
        total, n, words = np.zeros(len(self.langs)), 0, WORD.finditer((text or "").lower())
        while part := [m[0] for m in islice(words, min(self.most, PART))]:
            self._take_in(part)
            total, n = total + self.rows[[self.place[w] for w in part]].sum(axis=0, dtype=float), n + len(part)
        if not self.langs or not n:
            return UNKNOWN, 0.0
        mean = total / n
        e = np.exp(mean - mean.max())
        best = int(np.argmax(e))
        return self.langs[best], float(e[best] / e.sum())


def train(docs: DataFrame, *, per_lang: int = 4000, longest: int = 4) -> Model:
    """A model of docs (doc_id, text, lang), from the rows whose text and lang are not null.

    Bound: of each language the rows of smallest id hash are read, `per_lang` of them but for the hash's spread. Every word
    and n-gram of these rows is in the model, so its size follows from this sample and not from the table.
    """
    ship(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null")
    limits = rows.groupBy("lang").count().collect()
    if not limits:
        return Model([], longest, [], np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(x) for r in limits for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    sample = rows.where(F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1)) <= share[F.col("lang")] * F.lit(float(2**63))).select("lang", "text")
    counts = sample.mapInArrow(_units(longest), "lang string, kind string, unit string, n long")
    langs = sorted(r["lang"] for r in limits)
    of = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    t = counts.groupBy("kind", "unit").agg(*of).orderBy(F.col("kind") != "w", "kind", "unit").toArrow()
    kinds, units = t["kind"].to_pylist(), t["unit"].to_pylist()
    n = np.stack([t[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1).astype(float) if langs else np.zeros((len(t), 0))
    logs = np.zeros_like(n)
    for k in set(kinds):
        at = np.array([x == k for x in kinds], bool)
        logs[at] = np.log((n[at] + 0.1) / (n[at].sum(axis=0) + 0.1 * at.sum()))
    return Model(langs, longest, list(zip(kinds, units, strict=True)), logs.astype(np.float32))


def predict(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """docs' `columns` and (lang_pred, score) for every row of docs; text is looked at and no other column.

    A word is a letter with the letters and combining marks that follow it; numerals are none. Null texts and those
    without a letter are UNKNOWN with score 0, as is every text if the model has learned no language.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value  # a worker's tasks share it, and it goes with the last that needs it
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column(0)]
            arrays = [*batch.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "lang_pred", "score"])

    source = docs.select(F.col("text").alias("_text_"), *columns)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]), "lang_pred string", "score double"])
    return source.mapInArrow(run, shape)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return predict(docs.withColumn("held_out", fold("doc_id", 4) == 2), model, ["doc_id", "held_out"])
