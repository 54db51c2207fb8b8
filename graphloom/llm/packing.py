"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import Held, load, materialize, ship

#: Fixed values of the byte-level BPE vocabulary: the pattern that splits a text before merging, and its special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
LONG = 1 << 20


class Encoder:
    """The ids of a tokenizer file. With a ranks file of the same vocabulary a faster library gives the same ids for
    most texts; those that hold the special token or are very long go through the tokenizer itself."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and len(text) < LONG and SPECIAL not in text:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones of `most`, after a first one of what is left over."""
    first = n % most
    return [(0, first)] * (first > 0) + [(at, most) for at in range(first, n, most)]


class Capacities:
    """Which remaining capacities some open bin has, as a segment tree: the tightest that takes a length, in logarithmic time."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, left: int) -> None:
        at = left + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def drop(self, left: int) -> None:
        at = left + self.size
        self.any[at] = 0
        at >>= 1
        while at and not (self.any[2 * at] or self.any[2 * at + 1]):
            self.any[at] = 0
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least `length` that some bin has."""
        at = length + self.size
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at + (not self.any[2 * at])
        return at - self.size


def best_fit(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] items of each length, 1 to `most`, into bins of `most`.

    The places of a length's items, by their rank from 0, as runs (length, first rank, first bin, items a bin, offset in
    it): the item of rank r lies in bin first bin + (r - first rank) // items a bin. Items of one length and bins of one
    remaining capacity are alike, so they are placed together: an item put into the tightest bin leaves one tighter
    still, which takes the next of its length until none fits. The work depends on the lengths, not on the counts.
    """
    tree, open_, bins, runs = Capacities(most), {}, 0, []  # open_: remaining capacity to runs [first bin, bins]

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            open_.setdefault(left, []).append([first, n])
            tree.put(left)

    for length in sorted(counts, reverse=True):
        rank, items = 0, counts[length]
        while items:
            left = tree.tightest(length)
            if left is None:
                left, each = most, most // length
                first, n = bins, -(-items // each)
                bins += n
            else:
                each = left // length
                first, n = open_[left].pop()
                if not open_[left]:
                    del open_[left]
                    tree.drop(left)
            full = min(n, items // each)
            if full:
                runs.append((length, rank, first, each, most - left))
                rank, items = rank + full * each, items - full * each
                put(left - each * length, first, full)
            if full < n:
                if items:  # fewer than fill one more bin
                    runs.append((length, rank, first + full, each, most - left))
                    put(left - items * length, first + full, 1)
                    full, items = full + 1, 0
                put(left, first + full, n - full)
    return runs


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pieces(docs: DataFrame, most: int, end: int, path: str, ranks: str | None) -> DataFrame:
    """Every piece of docs, with the task it was cut in (part) and its rank among the pieces of its length there (nth)."""

    def run(batches):
        encoder = sent.value.get()
        part, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.array([end], "<u4"))
                for k, (s, n) in enumerate(cut(len(ids), most)):
                    out.append((doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Held(partial(Encoder, path, ranks)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def _placed(sent):
    """Rows of pieces and `base`, the pieces of their length in earlier parts, to their places."""

    def run(batches):
        length, rank, first, each, offset = sent.value
        for batch in batches:
            own, r = batch.column(3).to_numpy(), batch.column(6).to_numpy() + batch.column(7).to_numpy()
            # Runs are in order of length and rank.
            at = np.zeros(len(own), np.int64)
            for n in np.unique(own):
                i, lo, hi = np.flatnonzero(own == n), *np.searchsorted(length, [n, n + 1])
                at[i] = lo + np.searchsorted(rank[lo:hi], r[i], "right") - 1
            bin_, nth = np.divmod(r - rank[at], each[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + bin_), pa.array(offset[at] + nth * own)], names=list(PLACED))

    return run


def pack(docs: DataFrame, path: str, *, ranks: str | None = None, most: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs (doc_id, text).

    A document is its text's ids and then `end`; null texts are empty, so every row, repeats too, gives one piece at
    least. All pieces are packed at once, best-fit decreasing: what decides is how many have each length, and these
    counts, `most` rows at most, are all that reaches the driver. It answers with runs of places, whose number depends on
    the lengths alone, and each piece finds its own by its rank in its length: that in its task and the count of the tasks
    before. Extra columns are ignored; an empty table gives no rows.
    """
    found = materialize(pieces(docs, most, end, path, ranks), "pieces")
    tasks = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = materialize(tasks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "tasks")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit(counts, most)), np.int64).reshape(-1, 5)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(runs.T.copy()))
    ranked = found.join(tasks.select("part", "length", "base"), ["part", "length"])
    columns = [c.split()[0] for c in PIECES.split(", ")]
    return ranked.select(*columns, "base").mapInArrow(_placed(sent), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def files() -> dict:
    """The production vocabulary: the tokenizer's file and its ranks."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents").select("doc_id", "text"), **files())
