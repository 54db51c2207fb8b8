"""Near-duplicate documents by word shingles: SimHash and MinHash candidates, each verified by the Jaccard similarity of its sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, ship
from graphloom.llm.components import connected_components
from graphloom.llm.simhash import SEED, _ones, _word_lists, near_links

#: Shingle ids in a part of a bucket, expected; up to MOST_IDS documents' ids are broadcast.
PART, MOST_IDS = 1 << 15, 8_000_000


def hashes(data: bytes | None, width: int) -> np.ndarray:
    """The hash of every shingle of a UTF-8 text, in its order; of all words where they are fewer than `width`; none without words."""
    digest, rest, out, few = xxhash.xxh64_intdigest, [], [], True
    for words in _word_lists(data or b""):
        words = rest + words
        own = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)), strict=False)]
        rest, few = words[-(width - 1) :] if width > 1 else [], few and not own
        out.append(np.array(own, np.uint64))
    if few and rest:
        out.append(np.array([digest(b" ".join(rest), SEED)], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def minima(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest of a set's hashes under each factor."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(low, (own[None, at : at + 1024] * factors[:, None]).min(axis=1), out=low)
    return low


def node_of(own: np.ndarray) -> int:
    """One signed number for a set, given its hashes in order."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def _signed(width: int, bands: int, rows: int):
    """Rows (doc_id, text) to (doc_id, node, size, fp, bands): the number of the shingle set, its size, SimHash and MinHash bands."""
    factors = np.random.default_rng(11).integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for x in batch.column(1):
                every = hashes(x.as_buffer().to_pybytes() if x.is_valid else None, width)
                own = np.unique(every)
                nodes.append(node_of(own))
                sizes.append(len(own))
                fps.append(int(np.packbits(2 * _ones(every) > len(every), bitorder="little").view("<i8")[0]) if len(every) else 0)
                low = minima(own, factors).reshape(bands, rows)
                keys.append([int(np.uint64(xxhash.xxh3_64_intdigest(b.tobytes())).astype(np.int64)) for b in low])
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "node", "size", "fp", "bands"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                own = np.unique(hashes(x.as_buffer().to_pybytes() if x.is_valid else None, width))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(own)], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], names=["node", "own"])

    return run


def _verified(least: float):
    """Rows (a, b, x, y) to the (a, b) whose sets x and y are alike enough."""

    def run(batches):
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                yes.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(yes, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return run


def block_links(node: np.ndarray, root: np.ndarray, part: np.ndarray, sets: list[np.ndarray], least: float, across: bool) -> list[tuple[int, int]]:
    """Links between sets of differing roots that are alike enough, as many as join all the roots that such links join.

    across: only sets of differing parts are compared. Of two differing roots one at least is not the most frequent
    one, so only the sets of the other roots are held against all; sets too small or too large to be alike are left
    out, which loses none.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    node, root, part = node[order], root[order].copy(), part[order]
    sizes = np.array([len(sets[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids, local = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    names, counts = np.unique(root, return_counts=True)
    marked, found = np.zeros(len(ids), bool), []
    for a in np.flatnonzero(root != names[counts.argmax()]):
        low, high = np.searchsorted(sizes, least * sizes[a] - 1e-6), np.searchsorted(sizes, sizes[a] / least + 1e-6, "right")
        other = root[low:high] != root[a]
        if across:
            other &= part[low:high] != part[a]
        if not other.any():
            continue
        own = local[starts[a] : starts[a + 1]]
        marked[own] = True
        both = np.add.reduceat(marked[local[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        marked[own] = False
        for b in low + np.flatnonzero(other & (both >= least * (sizes[low:high] + sizes[a] - both))):
            if root[b] != root[a]:
                found.append((int(node[a]), int(node[b])))
                root[root == root[b]] = root[a]
    return found


def _blocks(least: float):
    """Rows (band, key, i, j, node, root, part, own) in the order of the first four: the links of each block."""

    def links(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        table = pa.Table.from_batches(rows)
        node, root, part = (table.column(c).to_numpy() for c in ("node", "root", "part"))
        sets = [x.values.to_numpy() for x in table.column("own")]
        return block_links(node, root, part, sets, least, rows[0].column("i")[0] != rows[0].column("j")[0])

    def run(batches):
        last, rows = None, []
        for batch in batches:
            keys, found = [batch.column(i).to_numpy() for i in range(4)], []
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if at == end:
                    continue
                name = tuple(int(k[at]) for k in keys)
                if rows and name != last:
                    found += links(rows)
                    rows = []
                last = name
                rows.append(batch.slice(at, end - at))
            yield _pairs(found)
        if rows:
            yield _pairs(links(rows))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def similar(docs: DataFrame, *, width: int = 5, least: float = 0.8, distance: int = 4, bands: int = 24, rows: int = 6) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id, text).

    Documents link when the sets of their `width`-word shingles have a Jaccard similarity of `least` or more;
    component_id is the smallest doc_id reachable over links. Equal sets are taken together first, texts without
    words too. Candidates are pairs of sets within `distance` bits of SimHash and pairs that agree in one of `bands`
    bands of `rows` MinHash values: at 0.8 a pair has one with probability 0.999, while its SimHashes differ in about
    ten of 64 bits, beyond any exact search. Every candidate is verified by its whole sets.

    A bucket's sets are first compared with its smallest one. Where that leaves sets of several components, each set
    outside the largest of these is compared with all others of the bucket, in blocks of two parts of about PART shingle
    ids: no candidate is left out at any size of a bucket, and no pairs but links leave a block. The cost of a bucket
    grows with its ids times those outside its largest component. A null doc_id belongs to its set's component, or to none.
    """
    spark = docs.sparkSession
    ship(spark)
    tidy = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = materialize(tidy.mapInArrow(_signed(width, bands, rows), "doc_id long, node long, size long, fp long, bands array<long>"), "signed")
    reps = signed.groupBy("node").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("size", "fp", "bands")])
    reps = materialize(reps.where("doc is not null"), "sets")

    keyed = reps.where("size > 0").select("node", "size", F.posexplode("bands").alias("band", "key"))
    places = keyed.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count("*").alias("n"), F.bit_xor("node").alias("mark")).where("n > 1")
    shared = materialize(keyed.join(places, ["band", "key"]), "buckets")
    # Sets of one fingerprint meet at its smallest; near_links takes one row a fingerprint.
    prints = reps.groupBy("fp").agg(F.min("node").alias("doc"))
    of_print = reps.select("fp", "node").join(prints, "fp").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    stars = shared.select(F.col("centre").alias("a"), F.col("node").alias("b")).union(of_print).union(near_links(prints, distance))
    stars = materialize(stars.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    asked = stars.select("a").union(stars.select("b")).union(shared.select("node")).toDF("node").distinct()
    ids = materialize(reps.join(asked, "node", "left_semi").select(F.col("doc").alias("doc_id")).distinct(), "asked")
    own = tidy.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "doc_id", "left_semi")
    sets = materialize(own.select("text").mapInArrow(_sets(width), "node long, own array<long>").dropDuplicates(["node"]), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("node").alias("a"), F.col("own").alias("x")), sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(least), "a long, b long")

    links = materialize(verified(stars), "alike")
    roots = connected_components(links)
    at = materialize(shared.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    by_root = at.groupBy("band", "key", "root").agg(F.sum("size").alias("ids"), *[F.first(c).alias(c) for c in ("centre", "n", "mark")])
    by_bucket = by_root.groupBy("band", "key").agg(
        F.max_by("root", "ids").alias("main"), F.max("ids").alias("most"), F.sum("ids").alias("ids"), F.count("*").alias("roots"), *[F.first(c).alias(c) for c in ("centre", "n", "mark")]
    )
    # Buckets of the same sets in several bands are one. Parts below `few` hold the sets outside the main component.
    few, all_ = F.ceil((F.col("ids") - F.col("most")) / PART), F.ceil((F.col("ids") - F.col("most")) / PART) + F.ceil(F.col("most") / PART)
    open_ = by_bucket.where("roots > 1").dropDuplicates(["mark", "centre", "n"]).select("band", "key", "main", few.alias("few"), all_.alias("all_"))
    own_part = F.when(F.col("root") != F.col("main"), F.pmod(F.xxhash64("node"), "few")).otherwise(F.col("few") + F.pmod(F.xxhash64("node"), F.col("all_") - F.col("few")))
    dealt = at.select("band", "key", "node", "root").join(open_, ["band", "key"]).withColumn("part", own_part)
    dealt = dealt.withColumn("with_", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("part") < F.col("few"), F.col("all_") - 1).otherwise(F.col("few") - 1))))
    dealt = dealt.select("band", "key", F.least("part", "with_").alias("i"), F.greatest("part", "with_").alias("j"), "node", "root", "part").join(sets, "node")
    blocks = dealt.select("band", "key", "i", "j", "node", "root", "part", "own").repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    more = materialize(blocks.mapInArrow(_blocks(least), "a long, b long").distinct(), "more")
    if more.limit(1).count():
        roots = connected_components(links.union(more))
    joined = reps.join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    small = joined.groupBy("root").agg(F.min("doc").alias("component_id"))
    found = materialize(joined.join(small, "root").select("node", "component_id"), "components")
    return signed.join(found, "node", "left").select("doc_id", "component_id")
