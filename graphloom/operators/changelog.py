"""The change log and its resolution: last write wins, merges on top of the last whole record, tombstones.

log: id string, seq long, op 'PUT' | 'PATCH' | 'DELETE', props map<string,variant>, and optionally version long for a
PUT that carries one. Other columns (labels of nodes; src, dst and type of edges) are fixed parts of a record, as its
last PUT gave them. seq is unique by id and is the only order. A PUT replaces the record, a PATCH sets its keys and
adds one to the version for each, a DELETE removes it; a PATCH of an absent record is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import TYPES, props_size
from graphloom.operators.asof import last_before


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row of highest order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_")).select(key, "_.*")


def fixed(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in ("id", "seq", "op", "props", "version", "checksum")]


def _bases(log: DataFrame) -> DataFrame:
    """Of each id the last PUT or DELETE: (id, base, base_op, base_props, base_version, the fixed columns)."""
    version = F.col("version") if "version" in log.columns else F.lit(None).cast("long")
    whole = log.where("op <> 'PATCH'").select("id", "seq", F.struct("seq", "op", "props", version.alias("version"), *fixed(log)).alias("r"))
    last = whole.groupBy("id").agg(F.max_by("r", "seq").alias("r"))
    return last.select("id", F.col("r.seq").alias("base"), F.col("r.op").alias("base_op"), F.col("r.props").alias("base_props"), F.col("r.version").alias("base_version"), *[F.col(f"r.{c}").alias(c) for c in fixed(log)])


def last_entries(log: DataFrame) -> DataFrame:
    """Of each id that the log puts or deletes what stands at its end: (id, seq, op, props, version, the fixed columns);
    op is PUT or DELETE, of a deleted id version is null and seq that of the deletion.

    Each property's last value is found without regard to the record, so patches combine before they are shuffled however
    many a record has; which of them come after its last PUT is then seen from their seq. Only the number of patched keys
    needs the patches one by one, and these meet their record without properties.
    """
    bases = _bases(log)
    patches = log.where("op = 'PATCH'").select("id", "seq", "props")
    keys = patches.select("id", "seq", F.explode("props").alias("k", "v")).groupBy("id", "k").agg(F.max("seq").alias("s"), F.max_by("v", "seq").alias("v"))
    live = bases.where("base_op = 'PUT'").select("id", "base")
    new = keys.join(live, "id").where("s > base").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("new"))
    sizes = patches.select("id", "seq", F.size("props").alias("n")).join(live, "id").where("seq > base").groupBy("id").agg(F.sum("n").alias("sets"), F.max("seq").alias("last"))
    found = bases.join(new, "id", "left").join(sizes, "id", "left")
    kept = F.when(F.col("new").isNull(), F.col("base_props")).otherwise(F.map_concat(F.map_filter("base_props", lambda k, _: ~F.map_contains_key("new", k)), "new"))
    start = F.coalesce("base_version", 1 + F.size("base_props"))
    version = F.when(F.col("base_op") == "PUT", (start + F.coalesce("sets", F.lit(0))).cast("long"))
    return found.select("id", F.coalesce("last", "base").alias("seq"), F.col("base_op").alias("op"), kept.alias("props"), version.alias("version"), *fixed(log))


def resolve(log: DataFrame) -> DataFrame:
    """The live records: (id, props, version, seq, the fixed columns)."""
    return last_entries(log).where("op = 'PUT'").select("id", "props", "version", "seq", *fixed(log))


def rejected(log: DataFrame) -> DataFrame:
    """The PATCH rows that found no live record when they came, with a reason."""
    marked = log.select("id", "seq", "op", F.when(F.col("op") != "PATCH", F.col("op")).alias("whole"))
    found = last_before(marked, "id", "seq", "whole", "state").where("op = 'PATCH' and coalesce(state, 'DELETE') = 'DELETE'")
    return found.select("id", "seq", F.lit("node not found").alias("reason"))


def status(log: DataFrame, requested: DataFrame) -> DataFrame:
    """(id, status) of requested ids: live, deleted, or absent if the log never put or deleted them."""
    state = F.when(F.col("base_op") == "PUT", "live").when(F.col("base_op") == "DELETE", "deleted").otherwise("absent")
    return requested.select("id").distinct().join(_bases(log).select("id", "base_op"), "id", "left").select("id", state.alias("status"))


def recover(snapshot: DataFrame, log: DataFrame, upto: int) -> DataFrame:
    """The state of snapshot (id, props, version, seq; all changes with seq <= upto) and the log after it."""
    base = snapshot.select("id", "seq", F.lit("PUT").alias("op"), "props", "version", *fixed(log))
    tail = log.where(F.col("seq") > upto).select("id", "seq", "op", "props", F.lit(None).cast("long").alias("version"), *fixed(log))
    return resolve(base.unionByName(tail))


def upsert(state: DataFrame, new: DataFrame) -> DataFrame:
    """Whole-record overwrite: rows of new (same columns) replace those of the same id, of several the last by seq."""
    last = latest(new, "id", "seq").select(*state.columns)
    return state.join(last.select("id"), "id", "left_anti").unionByName(last)


def update(state: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, rejected): one patch (id, new map<string,variant>) an id merged into props; patches without a record are rejected."""
    found = state.join(patches.select("id", "new"), "id", "left")
    kept = F.when(F.col("new").isNull(), F.col("props")).otherwise(F.map_concat(F.map_filter("props", lambda k, _: ~F.map_contains_key("new", k)), "new"))
    version = F.col("version") + F.coalesce(F.when(F.col("new").isNotNull(), F.size("new")), F.lit(0))
    out = found.withColumn("props", kept).withColumn("version", version.cast("long")).drop("new")
    return out, patches.join(state.select("id"), "id", "left_anti")


def checked_version(state: DataFrame, patches: DataFrame) -> DataFrame:
    """The patches (id, new, expected_version) whose record still has that version: optimistic locking."""
    return patches.join(state.select("id", F.col("version").alias("_v_")), "id").where("_v_ = expected_version").drop("_v_")


def set_property(rows: DataFrame, name: str, value) -> DataFrame:
    """One property set on every row; the version rises by one even if the value is the same."""
    kept = F.map_filter("props", lambda k, _: k != name)
    return rows.withColumn("props", F.map_concat(kept, F.create_map(F.lit(name), value.cast("variant")))).withColumn("version", F.col("version") + 1)


def valid_props(props):
    """Whether every value has one of the five property types."""
    names = {"string": "STRING", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "binary": "BINARY"}
    return F.forall(F.map_values(props), lambda v: F.coalesce(F.schema_of_variant(v).isin(*[names[t] for t in TYPES]), F.lit(False)))


def _checksum(log: DataFrame):
    own = [F.to_json(F.struct(*fixed(log)))] if fixed(log) else []
    return F.crc32(F.concat_ws("|", "id", F.col("seq").cast("string"), "op", F.coalesce(F.to_json("props"), F.lit("")), *own).cast("binary"))


def with_checksum(log: DataFrame) -> DataFrame:
    """log and the crc32 of each row's id, order, operation and properties as JSON, and of its fixed columns if it has any."""
    return log.withColumn("checksum", _checksum(log))


def verified(log: DataFrame) -> DataFrame:
    """log without its checksum column; a row that doesn't match it fails the query."""
    wrong = F.raise_error(F.concat(F.lit("checksum mismatch of id "), F.coalesce("id", F.lit("null")))).cast("boolean")
    # A test that is not deterministic stays apart from later filters, whose constants would else enter the checksum.
    return log.where(F.when(_checksum(log) == F.col("checksum"), F.monotonically_increasing_id() >= 0).otherwise(wrong)).drop("checksum")


def stats(log: DataFrame) -> DataFrame:
    """(op, writes, bytes) of a log; bytes are those of ids and of properties."""
    return log.groupBy("op").agg(F.count("*").alias("writes"), F.sum(F.octet_length("id") + props_size(F.col("props"))).alias("bytes"))
