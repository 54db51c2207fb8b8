"""Embedding near-duplicates by sorted projection passes, with exact link counts inside each component."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import load, local_roots, materialize
from graphloom.llm.components import connected_components

HASH_BITS, LEAST_CHUNK, TILE = 63, 128, 1 << 21
#: The share of pairs at the threshold that the passes of a label are to meet, and the most passes of one.
AIM, MOST_PASSES = 0.99, 256
#: By how many bits more than even shares need a pair must agree; see passes_for.
CROWDED = 2.0


@lru_cache(maxsize=512)
def _planes(dim: int, number: int, seed: int) -> np.ndarray:
    """The planes of one pass."""
    return np.random.default_rng([seed, dim, number]).standard_normal((dim, HASH_BITS))


def _unit(values: pa.ListArray) -> np.ndarray:
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    # By the largest component first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sums(batches):
    """Rows (label, v) to the task's sums of unit vectors: (label, dim, n, total)."""
    held: dict = {}
    for batch in batches:
        label, v = batch.column(0).to_numpy(), batch.column(1)
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            labels, own = np.unique(label[at], return_inverse=True)
            x, total = _unit(v.take(pa.array(at))), np.zeros((len(labels), dim))
            np.add.at(total, own, x)
            for k, n, t in zip(labels.tolist(), np.bincount(own).tolist(), total, strict=True):
                old = held.get((k, int(dim)), (0, 0.0))
                held[k, int(dim)] = old[0] + n, old[1] + t
        if len(held) > 4096:
            yield _summed(held)
            held = {}
    yield _summed(held)


def _summed(held: dict) -> pa.RecordBatch:
    cols = [pa.array([k for k, _ in held], pa.int64()), pa.array([d for _, d in held], pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([t for _, t in held.values()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(cols, names=["label", "dim", "n", "total"])


def passes_for(n: int, centre: np.ndarray, threshold: float, window: int, least: int) -> int:
    """How many passes meet AIM of the pairs at the threshold among n unit vectors of mean `centre`."""
    rest = max(1 - float(centre @ centre), 1e-12)
    near = 1 - np.arccos(max(-1.0, 1 - (1 - threshold) / rest)) / np.pi
    # A group of equal prefixes is no even share of the rows: the pair must be met in one some times larger.
    one = near ** max(0.0, np.log2(max(n, 1) / window) + CROWDED)
    return least if one >= AIM else int(min(max(least, np.ceil(np.log(1 - AIM) / np.log1p(-one))), max(least, MOST_PASSES)))


def _centres(threshold: float, window: int, least: int):
    """The sums of one label and length to (label, dim, centre, passes)."""

    def run(key, table):
        n = table["n"].to_numpy().sum()
        centre = np.sum(table["total"].to_pylist(), axis=0) / n
        return pa.table({"label": [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "passes": pa.array([passes_for(int(n), centre, threshold, window, least)], pa.int32())})

    return run


def _signatures(seed: int):
    """Rows (rep, label, v, centre, passes) to one row a pass with its concatenated hash bits; (label, pass, sig, rep, v)."""

    def run(batches):
        for batch in batches:
            rep, label, v, centre, passes = (batch.column(i) for i in range(5))
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            numbers = passes.to_numpy()
            for dim, count in np.unique(np.stack([sizes, numbers]), axis=1).T:
                at = np.flatnonzero((sizes == dim) & (numbers == count))
                for part in np.array_split(at, max(1, len(at) // 2048)):
                    own = v.take(pa.array(part))
                    x = _unit(own) - centre.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                    for p in range(count):
                        bits = x @ _planes(int(dim), p, seed) >= 0
                        sig = (bits.astype(np.int64) << np.arange(HASH_BITS - 1, -1, -1)).sum(axis=1)
                        cols = [label.take(pa.array(part)), pa.array(np.full(len(part), p, np.int32)), pa.array(sig), rep.take(pa.array(part)), own]
                        yield pa.RecordBatch.from_arrays(cols, names=["label", "pass", "sig", "rep", "v"])

    return run


#: Kinds of components.
NUMPY = {"float": np.float32, "double": np.float64, "int": np.int32, "bigint": np.int64, "smallint": np.int16, "tinyint": np.int8}
#: What the window task gives: a link, or a row at a border.
BORDER = ["a", "b", "border", "side", "label", "pass", "sig", "rep", "v"]


def _window_links(threshold: float, window: int, kind: pa.DataType):
    """Rows (label, pass, sig, rep, v) sorted by (label, dim, pass, sig) in ranges, one a task: links between rows at
    most `window` places apart, as spanning stars (a, b), and the range's first and last `window` rows, each with the
    border at which they meet those of the next range: (border, side, label, pass, sig, rep, v)."""
    none = pa.array([], pa.int64())

    def bordering(rows, border, side):
        n = rows.num_rows
        same = lambda x, t: pa.array(np.full(n, x), t)
        cols = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), same(border, pa.int32()), same(side, pa.int32()), *rows.columns]
        return pa.Table.from_arrays(cols, names=BORDER).combine_chunks().to_batches()

    def run(batches):
        number, head, tail = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                piece = pa.Table.from_batches([batch.slice(start, 4096)])
                if head is None or head.num_rows < window:
                    head = piece.slice(0, window) if head is None else pa.concat_tables([head, piece]).slice(0, window)
                rows = piece if tail is None else pa.concat_tables([tail, piece])
                tail = rows.slice(max(0, rows.num_rows - window))
                for a, b in links(rows.combine_chunks()):
                    n = len(a)
                    nulls = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, kind)]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *nulls], names=BORDER)
        if tail is not None:
            if number:
                yield from bordering(head, number - 1, 1)
            yield from bordering(tail, number, 0)

    def met(key, table):
        """The rows at one border, the end of a range and the start of the next: their links."""
        pairs = list(links(table.sort_by([("side", "ascending"), ("label", "ascending"), ("pass", "ascending"), ("sig", "ascending"), ("rep", "ascending")]).combine_chunks()))
        return pa.table({c: pa.array(np.concatenate([p[i] for p in pairs])) if pairs else none for i, c in enumerate(("a", "b"))})

    def links(rows):
        v = rows["v"].combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        sizes, rep = v.value_lengths().to_numpy(zero_copy_only=False), rows["rep"].to_numpy()
        group = np.stack([rows["label"].to_numpy(), rows["pass"].to_numpy(), sizes])
        change = np.concatenate([[0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1, [len(rep)]])
        a, b = [], []
        for lo, hi in zip(change, change[1:], strict=False):
            x = _unit(v.slice(lo, hi - lo)) if hi - lo > 1 else None
            for d in range(1, min(window, hi - lo - 1) + 1):
                at = np.flatnonzero(np.einsum("ij,ij->i", x[d:], x[:-d]) >= threshold) + lo
                a.append(at)
                b.append(at + d)
        if not a or not len(at := np.concatenate(a)):
            return
        root = local_roots(len(rep), at, np.concatenate(b))
        own = np.flatnonzero(root != np.arange(len(rep)))
        yield rep[root[own]], rep[own]

    return run, met


def _cell_links(threshold: float):
    """One cell (two chunks of a component): each row's number of linked rows, of the other chunk or its own."""

    def run(key, table):
        own, other = key[1].as_py(), key[2].as_py()
        rep, n, chunk = (table[c].to_numpy() for c in ("rep", "copies", "chunk"))
        v = table["v"].combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        x = _unit(v)
        i, j = np.flatnonzero(chunk == own), np.flatnonzero(chunk == other)
        to_i, to_j, y, step = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64), x[j], max(1, TILE // max(1, len(j)))
        for at in range(0, len(i), step):  # in tiles, so that no matrix of the whole cell is held
            part = i[at : at + step]
            near = x[part] @ y.T >= threshold
            if own == other:
                near[np.arange(len(part)), np.arange(at, at + len(part))] = False
            else:
                to_j += near.T @ n[part]
            to_i[at : at + step] = near @ n[j]
        found = [(rep[i], to_i)] if own == other else [(rep[i], to_i), (rep[j], to_j)]
        return pa.table({"rep": np.concatenate([x for x, _ in found]), "links": np.concatenate([x for _, x in found]).astype(np.int64)})

    return run


def near_duplicates(rows: DataFrame, *, threshold: float = 0.98, passes: int = 12, window: int = 64, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths equal and their cosine in double precision
    at least `threshold`. Null, empty and zero vectors and those with null or non-finite components link with
    nothing. Each row counts as a vector of its own, repeats of a vec_id too; a null vec_id links with nothing.

    Equal vectors of a label are first taken together and stand as one. Each pass orders the rest by 63 concatenated
    random-hyperplane bits of the unit vectors less their label's mean, so that a direction they share hides nothing,
    and compares every vector with the next `window` ones, over the border to the next range too; verified pairs of all passes are united. A pair
    at the threshold keeps one bit with a probability that falls as the label gets denser (0.936 at cosine 0.98 around
    the origin), and so does the recall of one pass with the logarithm of the rows. From both, each label has as many
    passes as meet 0.99 of such pairs, `passes` at least and MOST_PASSES at most, beyond which recall falls. Inside the components so found, all pairs are then compared in
    chunks: link counts are exact there however large a group is, and no pair is written out.
    """
    finite = F.coalesce(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    usable = finite & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    v = F.transform("embedding", lambda x: (x + F.lit(0).cast(kind)).cast(kind))  # no negative zeros; as wide as it came
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, F.col("label").cast("long")).alias("label"), F.when(usable, v).alias("v"))
    good = base.where("v is not null")
    reps = materialize(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    # A vec_id repeated with other vectors or labels must not unite them: nodes are numbered apart from ids.
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")
    shape = f"label long, pass int, sig long, rep long, v array<{kind}>"
    sums = reps.select("label", "v").mapInArrow(_sums, "label long, dim int, n long, total array<double>")
    centres = sums.groupBy("label", "dim").applyInArrow(_centres(threshold, window, passes), "label long, dim int, centre array<double>, passes int")
    centred = reps.select(F.col("node").alias("rep"), "label", "v", F.size("v").alias("dim")).join(materialize(centres, "centres"), ["label", "dim"])
    signed = centred.select("rep", "label", "v", "centre", "passes").mapInArrow(_signatures(seed), shape)
    dealt = signed.repartitionByRange("label", F.size("v"), "pass", "sig", "rep").sortWithinPartitions("label", F.size("v"), "pass", "sig", "rep")
    windows, met = _window_links(threshold, window, pa.list_(pa.from_numpy_dtype(NUMPY[kind])))
    shape = f"a long, b long, border int, side int, label long, pass int, sig long, rep long, v array<{kind}>"
    found = materialize(dealt.mapInArrow(windows, shape), "windows")
    edges = found.where("border is not null").select("border", "side", "label", "pass", "sig", "rep", "v").groupBy("border").applyInArrow(met, "a long, b long")
    roots = connected_components(found.where("border is null").select("a", "b").union(edges))
    member = materialize(reps.join(roots.withColumnRenamed("root", "group"), "node"), "members")
    # Chunks grow with the square root of the group, so that neither a chunk nor the number of cells gets large.
    chunk = F.greatest(F.lit(float(LEAST_CHUNK)), 4 * F.sqrt(F.count("*")))
    sizes = member.groupBy("group").agg(F.ceil(F.count("*") / chunk).alias("n"))
    chunked = member.join(sizes, "group").withColumn("chunk", F.pmod(F.xxhash64("node"), "n"))
    both = chunked.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    both = both.select("group", F.least("chunk", "with").alias("own"), F.greatest("chunk", "with").alias("other"), "chunk", F.col("node").alias("rep"), "copies", "v")
    counted = both.groupBy("group", "own", "other").applyInArrow(_cell_links(threshold), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    small = member.groupBy("group").agg(F.min("rep").alias("component_id"))
    linked = member.join(small, "group").select("node", "component_id").join(counted, F.col("node") == F.col("rep"), "left").select("node", "component_id", "links")
    found = reps.join(linked, "node", "left").select("label", "v", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = materialize(found, "found")
    out = base.join(found, ["label", "v"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
