"""Scalar functions over ids, property maps and sizes, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32-bit FNV-1a offset basis and prime.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
#: Types of property values.
TYPES = ("string", "bigint", "double", "boolean", "binary")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes."""
    codes = F.filter(F.transform(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda h: F.conv(h, 16, 10).cast("long")), lambda b: b.isNotNull())
    return F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(4294967295)))


def lane(id_: Column, lanes: int = 16) -> Column:
    return fnv1a(id_) % lanes


def get_property(props: Column, name: str, kind: str) -> Column:
    """A property as the given type; null if it is missing or cannot be read as that type."""
    if kind not in TYPES:
        raise ValueError(f"no property type: {kind}")
    return F.try_variant_get(props[name], "$", kind)


def has_label(labels: Column, label: str) -> Column:
    return F.array_contains(labels, label)


def value_size(value: Column) -> Column:
    """Bytes of a property value: texts and binaries by length, numbers and truth values 8, anything else 16."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.octet_length(F.try_variant_get(value, "$", "string"))).when(kind == "BINARY", F.octet_length(F.try_variant_get(value, "$", "binary"))).when(kind.isin("BIGINT", "DOUBLE", "BOOLEAN"), F.lit(8)).otherwise(F.lit(16))


def props_size(props: Column) -> Column:
    return F.aggregate(F.map_entries(props), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + value_size(e["value"]))


def node_size(id_: Column, labels: Column, props: Column) -> Column:
    return (F.octet_length(id_) + 16 * F.size(labels) + props_size(props) + 64).cast("long")


def edge_size(id_: Column, src: Column, dst: Column, kind: Column, props: Column) -> Column:
    return (F.octet_length(id_) + F.octet_length(src) + F.octet_length(dst) + F.octet_length(kind) + props_size(props) + 64).cast("long")


def connections_size(ids: Column) -> Column:
    return 8 * F.size(ids)


def entry_size(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.octet_length(value)


def direction_name(d: Column) -> Column:
    return F.when(d == 0, "OUT").when(d == 1, "IN").when(d == 2, "BOTH").otherwise(F.concat(F.lit("Unknown("), d.cast("string"), F.lit(")")))


def parse_list(text: Column) -> Column:
    """The items of a list in which each is closed by a comma; empty items and an unclosed tail are dropped."""
    return F.filter(F.split(F.regexp_extract(text, "^(?s)(.*),", 1), ","), lambda x: x != "")


def persisted_time(ts: Column) -> Column:
    return F.date_trunc("SECOND", ts)


def uniform(id_: Column) -> Column:
    """A repeatable number in [0, 1) from a whole number."""
    return ((id_ * F.lit(2654435761)) % F.lit(4294967296)).cast("double") / F.lit(4294967296.0)


def zipf_pick(u: Column, n: int) -> Column:
    return F.floor(F.lit(float(n - 1)) * F.pow(u, F.lit(2.2))).cast("long")


def hotspot_pick(u: Column, n: int, share: float = 0.8, part: int = 5) -> Column:
    """`share` of the picks fall evenly in the first n / part items, the others evenly in the rest."""
    hot = max(1, n // part)
    return F.when(u < share, F.floor(u / F.lit(share) * F.lit(float(hot)))).otherwise(F.lit(hot) + F.floor((u - F.lit(share)) / F.lit(1.0 - share) * F.lit(float(max(n - hot, 0))))).cast("long")


def sequential_pick(worker: Column, i: Column, n: int) -> Column:
    return (worker * 1000 + i) % n


def cache_split(total: int) -> tuple[int, int, int]:
    return total * 40 // 100, total * 30 // 100, total * 30 // 100


def aligned(n: Column, block: int = 512) -> Column:
    """n bytes rounded up to whole blocks."""
    return (F.ceil(n / F.lit(block)) * F.lit(block)).cast("long")
