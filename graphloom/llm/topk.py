"""Exact top-k inner-product search by the three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import load, ship


def _valid(vector: str):
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantize(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """Keeps the rows whose vector has only finite components, with each component as floor(scale * x)."""
    return df.where(_valid(vector)).withColumn(vector, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T over integers: by doubles where those are exact, else by whole numbers held to the range of a long."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    out = a.astype(object) @ b.astype(object).T
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ids ascend."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at].astype(float) if len(at) and np.abs(scores[at]).max() < 2**53 else np.array([-int(x) for x in scores[at]], dtype=object), kind="stable")[:k]]


def _blocks(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Packs rows (dim, id, v) into blocks of one dimension: (dim, <name>, ids, v) with ids ascending."""
    # One row per vector length, so sizes can be no longer than the longest vector: it is safe to broadcast.
    sizes = rows.groupBy("dim").count().withColumn("n", F.ceil(F.col("count") / block))
    dealt = rows.join(F.broadcast(sizes.select("dim", "n")), "dim").withColumn(name, F.pmod(F.xxhash64("id"), F.col("n")))

    packed = dealt.groupBy("dim", name, "n").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows"))
    return packed.select("dim", name, F.col("n").alias(f"{name}_n"), F.col("rows.id").alias(f"{name}_ids"), F.flatten("rows.v").alias(f"{name}_v"))


def _matrix(column: pa.ListScalar, dim: int, n: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)


def _segments(dim: int, m: int) -> list[slice]:
    edges = np.linspace(0, dim, min(m, max(dim, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _phase(k: int, m: int, final: bool):
    """The work on one cell (a block of queries and one of candidates)."""

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for row in range(batch.num_rows):
                get = lambda c, r=row, b=batch: b.column(b.schema.get_field_index(c))[r]
                dim = get("dim").as_py()
                q_ids, c_ids = (get(c).values.to_numpy() for c in ("q_ids", "c_ids"))
                q, c = _matrix(get("q_v"), dim, len(q_ids)), _matrix(get("c_v"), dim, len(c_ids))
                parts = [(s, _dot(q[:, s], c[:, s])) for s in _segments(dim, m)]
                cuts = get("cuts").as_py() if final else None
                for i, q_id in enumerate(q_ids):
                    if final and cuts[i] is not None:
                        # A total of at least the cutoff needs a part of at least cutoff / m, rounded up.
                        seen = np.zeros(len(c_ids), bool)
                        for _, p in parts:
                            seen |= p[i] >= -(-cuts[i] // len(parts))
                        at = np.flatnonzero(seen & (c_ids != q_id))
                    elif final:
                        at = np.flatnonzero(c_ids != q_id)
                    else:
                        own = np.flatnonzero(c_ids == q_id)
                        at = np.unique(np.concatenate([_best(p[i], c_ids, k + len(own)) for _, p in parts] or [np.arange(min(len(c_ids), k + len(own)))]))
                        at = at[c_ids[at] != q_id]
                    if not len(at):
                        continue
                    total = sum((p[i][at].astype(object) for _, p in parts), np.zeros(len(at), object))
                    total = np.clip(total, -(2**63), 2**63 - 1).astype(np.int64)
                    if final and cuts[i] is not None:
                        at, total = at[total >= cuts[i]], total[total >= cuts[i]]
                    best = _best(total, c_ids[at], k)
                    out[0].append(np.full(len(best), q_id))
                    out[1].append(c_ids[at][best])
                    out[2].append(total[best])
            arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, *, parts: int = 2, query_block: int = 1024, block: int = 4096) -> DataFrame:
    """The k rows of highest inner product for each query: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    rows and queries have (vec_id long, embedding array<long>). A query's own vec_id is no candidate; rows without an
    id take no part; identical rows count once, and several vectors under one id are candidates of their own, of which
    the best counts; so it is with queries: several vectors under one query id are all asked, and a candidate's best score
    counts. Vectors are compared within one length; products beyond a long are held to its range. Empty tables give no rows. Other columns are ignored.

    Queries and rows are dealt into blocks of bounded size and every pair of blocks is one cell of work. A vector's
    components are cut into `parts` ranges, each with a local list of partial scores. Phase 1 gathers each local
    list's k best entries and their totals; the k-th best total is a lower bound of the k-th best overall, the safe
    cutoff. It travels with the query block to all cells. Phase 2 collects the entries of at least cutoff / parts in
    some list, which every result must have, and phase 3 adds their missing parts and keeps the exact best.
    """
    ship(rows.sparkSession)
    tidy = lambda df: df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim")).distinct()
    c = _blocks(tidy(rows), block, "c")
    q = _blocks(tidy(queries), query_block, "q")
    n_c, n_q = c.select("dim", "c_n").distinct(), q.select("dim", "q_n").distinct()
    all_c = c.join(F.broadcast(n_q), "dim").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_n") - 1)))
    shape = "query_id long, vec_id long, score long"
    by_query, by_rank = Window.partitionBy("query_id"), [F.desc("score"), F.asc("vec_id")]

    def cells(q_blocks: DataFrame) -> DataFrame:
        all_q = q_blocks.join(F.broadcast(n_c), "dim").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_n") - 1)))
        return all_q.drop("q_n", "c_n").join(all_c.drop("q_n", "c_n").hint("shuffle_hash"), ["dim", "q", "c"])

    first = cells(q).mapInArrow(_phase(k, parts, False), shape)
    ranked = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by_query.orderBy(*by_rank))).where(f"r <= {k}")
    cut = ranked.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("cut"))
    flat = q.select("dim", "q", F.posexplode("q_ids").alias("at", "query_id")).join(cut, "query_id", "left")
    cuts = flat.groupBy("dim", "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cut"))), lambda x: x["cut"]).alias("cuts"))
    last = cells(q.join(cuts, ["dim", "q"])).mapInArrow(_phase(k, parts, True), shape)
    best = last.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by_query.orderBy(*by_rank))).where(f"rank <= {k}")
    return best.select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = quantize(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 256.0)
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


OP1_SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(max(list_inner_product(q.e, c.e)) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by 1, 2
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
