"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by one-wildcard segment variants."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import load, local_roots, materialize, ship
from graphloom.llm.components import connected_components

BITS, SEED, CHUNK = 64, 42, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(data: bytes):
    """The lower-cased words, in lists of bounded length so that a very long text is never split at once."""
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > CHUNK:
            found = SPACE.search(data, start + CHUNK)
            end = found.start() if found else end
        yield data[start:end].lower().split()
        start = end


def fingerprint(data: bytes | None, width: int = 4) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 without words or text."""
    digest, rest = xxhash.xxh64_intdigest, []
    ones, n, few = np.zeros(BITS, np.int64), 0, True
    for words in _word_lists(data or b""):
        words = rest + words
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)), strict=False)]
        rest = words[-(width - 1) :] if width > 1 else []
        if hashes:
            few, n = False, n + len(hashes)
            ones += _ones(np.array(hashes, np.uint64))
    if few:
        if not rest:
            return 0
        n, ones = 1, _ones(np.array([digest(b" ".join(rest), SEED)], np.uint64))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, lowest bit first."""
    total = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        piece = hashes[part : part + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row of docs (doc_id, text); other columns are ignored."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Segments:
    """The cut of a fingerprint so that of two fingerprints within `distance` bits some segment differs by one bit at most."""

    def __init__(self, distance: int):
        n = distance // 2 + 1
        edges = [BITS * i // n for i in range(n + 1)]
        self.of_bit = [s for s in range(n) for _ in range(edges[s], edges[s + 1])]
        self.masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        self.starts = edges[:-1]

    def first_shared(self, x: np.ndarray) -> np.ndarray:
        """For the differences x of pairs: the first bit whose variant both have; BITS if none."""
        out = np.full(len(x), BITS)
        for mask, start in zip(reversed(self.masks), reversed(self.starts), strict=True):
            part = x & np.uint64(mask)
            one = np.bitwise_count(part) == 1
            out[part == 0] = start
            if one.any():
                out[one] = np.log2(part[one].astype(np.float64)).round().astype(np.int64)
        return out


SMALL = 32


def _run_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within `distance` of each other in one run, at most one per row: a search whose
    unvisited rest shrinks, so a dense group is done after few scans."""
    a, b, left = [], [], np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= distance
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _bucket_links(cuts: Segments, distance: int):
    """Work on rows (key, cell, fp, doc) sorted by key and cell: links (a, b) between the docs of one run."""

    def linked(bit, fp, doc, starts, ends):
        pairs = [(np.zeros(0, np.int64),) * 2]
        sizes = ends - starts
        run = np.repeat(np.arange(len(starts)), sizes)
        small = sizes[run] <= SMALL
        for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
            at = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
            x = fp[at] ^ fp[at + d]
            at, x = (v[np.bitwise_count(x) <= distance] for v in (at, x))
            # Of the variants that a pair shares, only the first reports it.
            at = at[cuts.first_shared(x) == bit[at]] if len(at) else at
            pairs.append((doc[at], doc[at + d]))
        for s in np.flatnonzero(sizes > SMALL):
            own = slice(starts[s], ends[s])
            i, j = _run_links(fp[own], distance)
            pairs.append((doc[own][i], doc[own][j]))
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))

    def run(batches):
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(4)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            key, cell = held[0], held[1]
            change = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            if not len(change):
                continue
            end = change[-1]
            yield from emit([x[:end] for x in held], change[:-1])
            held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            yield from emit(held, change)

    def emit(rows, change):
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(rows[0])]])
        a, b = linked(rows[0] >> 32, rows[2].view(np.uint64), rows[3], starts, ends)
        if len(a):
            # A spanning star of what this piece connects says the same in fewer rows.
            docs, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = local_roots(len(docs), at[: len(a)], at[len(a) :])
            own = np.flatnonzero(root != np.arange(len(docs)))
            yield pa.RecordBatch.from_arrays([pa.array(docs[root[own]]), pa.array(docs[own])], names=["a", "b"])

    return run


def near_links(reps: DataFrame, distance: int = 4, *, hot: int = 8192) -> DataFrame:
    """Links (a, b) that connect exactly the docs of reps (doc long, fp long) within `distance` bits of each other.

    Not all pairs: those of a dense group are implied by the links that connect it. Each fingerprint has 64 variants,
    a segment with one bit wild, and equal variants meet. A variant whose segment value more than hot / 2
    fingerprints have is split into chunks of at most about hot / 2 rows, and each pair of chunks is a cell of its
    own, so no task holds a large group and no link is lost.
    """
    cuts = Segments(distance)
    bits = F.array(*[F.lit(x) for x in cuts.of_bit])
    starts, sizes = F.array(*[F.lit(x) for x in cuts.starts]), F.array(*[F.lit(bin(x).count("1")) for x in cuts.masks])
    segment = lambda s: F.expr(f"cast(shiftrightunsigned(fp, element_at(starts, {s} + 1)) & (shiftleft(1L, element_at(sizes, {s} + 1)) - 1) as long)")
    tools = reps.select("doc", "fp", bits.alias("of_bit"), starts.alias("starts"), sizes.alias("sizes"))
    values = tools.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(len(cuts.masks) - 1)))).withColumn("value", segment("s"))
    crowded = materialize(values.groupBy("s", "value").count().where(f"count > {hot // 2}"), "crowded")
    rows = tools.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1)))).withColumn("s", F.expr("element_at(of_bit, bit + 1)"))
    wild = "~shiftleft(1L, bit - element_at(starts, s + 1))"
    rows = rows.withColumn("value", segment("s")).select(F.expr(f"shiftleft(cast(bit as long), 32) | (value & {wild})").alias("key"), "fp", "doc")
    if crowded.limit(1).count():
        of = crowded.select("*", bits.alias("of_bit"), starts.alias("starts")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1)))).where("element_at(of_bit, bit + 1) = s")
        keys = of.groupBy(F.expr(f"shiftleft(cast(bit as long), 32) | (value & {wild})").alias("key")).agg(F.ceil(2 * 2 * F.sum("count") / hot).alias("n"))
        rows = rows.join(keys, "key", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), "n"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        rows = rows.select("key", F.expr("least(own, other) * n + greatest(own, other)").alias("cell"), "fp", "doc")
    else:
        rows = rows.select("key", F.lit(0).cast("long").alias("cell"), "fp", "doc")
    dealt = rows.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(_bucket_links(cuts, distance), "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    fp is the signed fingerprint; component_id is the smallest doc_id reachable over links of at most `distance`
    bits. Null and word-less texts have fingerprint 0 and link like any other; repeated rows stay; a null doc_id
    belongs to its fingerprint's component; an empty table gives no rows; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, width), "fps")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "reps")
    roots = connected_components(near_links(reps.where("doc is not null"), distance))
    found = reps.join(roots, F.col("doc") == F.col("node"), "left").select("fp", F.coalesce("root", "doc").alias("component_id"))
    # Materialised, so that both sides of the last join are plain exchanges and a crowded fingerprint can be split.
    return fps.join(materialize(found, "components"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
