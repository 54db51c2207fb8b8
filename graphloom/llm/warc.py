"""WARC records: reading, writing, and resolving not-modified revisits to the full response they stand for."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import load, materialize, ship

#: Headers that a 304 must not change in the stored response (RFC 9111, section 3.2, and framing).
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
RECORD = "warc_type string, target_uri string, warc_date string, record_id string, profile string, refers_to string, http_status int, http_headers map<string,string>, payload binary"
#: Fixed value: how a gzip member begins.
GZIP = b"\x1f\x8b\x08"
#: A batch of records ends when their payloads reach this many bytes.
BATCH = 1 << 25
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def write_record(warc_type: str, uri: str, date: str, record_id: str, *, status: int | None = None, headers: dict | None = None, payload: bytes = b"", profile: str | None = None, refers_to: str | None = None) -> bytes:
    """One record of version 1.1, its block an HTTP message if there is a status."""
    block = payload
    if status is not None:
        lines = [f"HTTP/1.1 {status} -", *(f"{k}: {v}" for k, v in (headers or {}).items())]
        block = "\r\n".join(lines).encode() + b"\r\n\r\n" + payload
    named = {"WARC-Type": warc_type, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Record-ID": record_id, "WARC-Profile": profile, "WARC-Refers-To": refers_to}
    named |= {"Content-Type": "application/http; msgtype=response" if status is not None else "application/octet-stream", "Content-Length": str(len(block))}
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in named.items() if v is not None)])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:  # a folded line continues the one before
            found[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if colon:
            last = name.strip().lower()
            found[last] = f"{found[last]}, {value.strip()}" if last in found else value.strip()
    return found


class _Members(io.RawIOBase):
    """The bytes of gzip members one after the other; a damaged member gives what it can, and reading goes on at the next."""

    def __init__(self, data):
        self.data, self.at, self.left, self.member = data, 0, b"", None

    def readable(self):
        return True

    def readinto(self, out):
        while not self.left:
            if self.member is None or self.member.eof:
                self.at = self.data.find(GZIP, self.at) if self.member is None else self.data.find(GZIP, self.at - len(self.member.unused_data))
                if self.at < 0:
                    self.at, self.member = len(self.data), None
                    return 0
                self.member = zlib.decompressobj(31)
            piece = bytes(self.data[self.at : self.at + (1 << 16)])
            if not piece:
                return 0
            try:
                self.left = self.member.decompress(piece)
                self.at += len(piece)
            except zlib.error:
                self.at, self.member = self.at + 1, None
        n = min(len(out), len(self.left))
        out[:n], self.left = self.left[:n], self.left[n:]
        return n


def read_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped by file or by record; what is no record, damaged members of a gzipped
    file included, is skipped to the next one."""
    stream = io.BufferedReader(_Members(data)) if data[:3] == GZIP else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
        named = _headers(lines)
        length = named.get("content-length", "0")
        block = stream.read(int(length) if length.isdigit() else 0)
        status, http, payload = None, {}, block
        if named.get("content-type", "").startswith("application/http") and block.startswith(b"HTTP/"):
            head, _, payload = block.partition(b"\r\n\r\n")
            first, *rest = head.split(b"\r\n")
            word = first.split()[1:2]
            status, http = int(word[0]) if word and word[0].isdigit() else None, _headers(rest)
        yield {
            "warc_type": named.get("warc-type"), "target_uri": named.get("warc-target-uri"), "warc_date": named.get("warc-date"), "record_id": named.get("warc-record-id"),
            "profile": named.get("warc-profile"), "refers_to": named.get("warc-refers-to"), "http_status": status, "http_headers": http, "payload": payload,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under path; files are the unit of work, as the format has no index.

    A file's records leave its task in batches of bounded payload. The file itself is held in memory once, as Spark's
    reader of binary files gives it, which also sets the limit of a file's size: 2 GB as stored.
    """
    types = {"http_status": pa.int32(), "http_headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    names = [x.split()[0] for x in RECORD.split(", ")]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "http_headers" else r[n] for r in rows], types.get(n, pa.string())) for n in names], names=names)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for r in read_records(data.as_py()):
                    rows.append(r)
                    size += len(r["payload"])
                    if size >= BATCH:
                        yield packed(rows)
                        rows, size = [], 0
                yield packed(rows)

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def canonical_url(url: Column) -> Column:
    """Lower-case host without www and default port, path without closing slashes, query in order without tracking; scheme and fragment go."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?.*$", 0), r"^\?", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(host), r"^www[0-9]*\.", ""), ":(80|443)$", ""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _entries(headers: str) -> Column:
    """A map's entries in order, which unlike the map can be compared."""
    return F.array_sort(F.map_entries(headers))


def resolve_revisits(records: DataFrame, *, buckets: int = 64) -> DataFrame:
    """(id, source_id, outcome, headers) for every not-modified revisit of records.

    records: id long, kind ('response' or 'revisit'), url, at timestamp, status int, headers map (lower-case names).
    A revisit's source is the latest response of status 200 with the same canonical URL before it, by (at, id).
    outcome: resolved; mismatch, if both have an etag (weakly compared) and these differ, or lacking one of them both
    have last-modified and these differ; unproven, if no validator is on both sides; orphan, without an earlier
    response, url or time. headers: of a resolved one, the source's as the 304 updates them, those of KEPT apart.
    Rows without an id are no revisits. Of several revisits under one id, and of several responses of status 200 that
    have a url and a time, one counts throughout: that of highest (at, url, headers by name), nulls lowest. Other
    responses and other columns are ignored.

    Time is cut into `buckets` ranges of about equal rows, and the search runs by (URL, bucket) with the last response
    of earlier buckets carried in, so a URL with a large share of all records is split; payloads are never moved.
    """
    usable = F.expr("kind = 'revisit' or kind = 'response' and status = 200 and url is not null and at is not null")
    row = F.struct("at", "url", _entries("headers").alias("entries"))
    once = records.where(F.col("id").isNotNull() & usable).groupBy("id", "kind").agg(F.max(row).alias("row"))
    once = materialize(once.select("id", "kind", "row.at", canonical_url(F.col("row.url")).alias("canon"), F.map_from_entries("row.entries").alias("headers")), "captures")
    light = once.where("canon is not null and at is not null").select("id", "kind", "at", "canon")
    found = light.agg(F.percentile_approx(F.col("at").cast("double"), [i / buckets for i in range(1, buckets)], 1000)).first()[0]
    cuts = F.array(*[F.lit(x) for x in sorted(set(found or []))]).cast("array<double>")
    dealt = light.withColumn("bucket", F.size(F.filter(cuts, lambda x: x < F.col("at").cast("double")))).withColumn("full", F.when(F.col("kind") == "response", F.struct("at", "id")))
    before = Window.partitionBy("canon", "bucket").orderBy("at", "id", "kind").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last("full", ignorenulls=True).over(before)).where("kind = 'revisit'")
    last = dealt.where("full is not null").groupBy("canon", "bucket").agg(F.max("full").alias("full"))
    marks = last.unionByName(near.where("near is null").select("canon", "bucket").distinct(), allowMissingColumns=True).groupBy("canon", "bucket").agg(F.max("full").alias("full"))
    carried = marks.withColumn("far", F.last("full", ignorenulls=True).over(Window.partitionBy("canon").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("canon", "bucket", "far")
    source = materialize(near.join(carried, ["canon", "bucket"], "left").select("id", F.coalesce("near", "far")["id"].alias("source_id")), "sources")
    both = once.where("kind = 'revisit'").select("id", F.col("headers").alias("new")).join(source, "id", "left")
    both = both.join(once.where("kind = 'response'").select(F.col("id").alias("source_id"), F.col("headers").alias("old")), "source_id", "left")
    tag = lambda side: F.regexp_replace(F.col(side)["etag"], "^W/", "")
    same = F.coalesce(tag("new") == tag("old"), F.col("new")["last-modified"] == F.col("old")["last-modified"])
    outcome = F.when(F.col("source_id").isNull(), "orphan").when(same, "resolved").when(~same, "mismatch").otherwise("unproven")
    allowed = F.map_filter("new", lambda k, _: ~k.isin(*KEPT))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))), allowed)
    return both.select("id", "source_id", outcome.alias("outcome"), F.when(outcome == "resolved", merged).alias("headers"))


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Every page as a response, and as recrawled a day later with the answer 304: the revisits, resolved to their payloads."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    first = pages.select((F.col("page_id") * 2).alias("id"), F.lit("response").alias("kind"), "url", at.alias("at"), F.lit(200).alias("status"), F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("age"), F.lit("0")).alias("headers"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("id"), F.lit("revisit").alias("kind"), "url", (at + F.expr("interval 1 day")).alias("at"), F.lit(304).alias("status"), F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("none"), F.lit("age"), F.lit("9")).alias("headers"))
    found = materialize(resolve_revisits(first.union(again)), "resolved")
    # Of a repeated page_id the row that stands for it there: of highest (url, etag).
    page = F.struct("url", F.md5("html").alias("md5"), F.length("html").cast("long").alias("n"))
    payload = pages.where("page_id is not null and url is not null").groupBy((F.col("page_id") * 2).alias("source_id")).agg(F.max(page).alias("p")).select("source_id", "p.md5", "p.n")
    done = F.col("outcome") == "resolved"
    return found.join(payload, "source_id", "left").select(
        F.expr("(id - 1) div 2").alias("page_id"), F.when(F.col("source_id").isNotNull(), F.expr("source_id div 2")).alias("source_page_id"), "outcome",
        F.when(done, F.col("md5")).alias("payload_md5"), F.when(done, F.col("n")).alias("payload_chars"),
        F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";").alias("headers"),
    )


OP7_SQL = r"""
with p as (select page_id, url, coalesce(html, '') as html,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages where page_id is not null and url is not null
    qualify row_number() over (partition by page_id order by url desc, md5(coalesce(html, '')) desc) = 1),
q as (select *, regexp_extract(bare, '^[^/?]*', 0) as host, regexp_replace(bare, '^[^/?]*', '') as rest from p),
r as (select *, array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_extract(rest, '\?.*$', 0), '^\?', ''), '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))), '&') as kept from q),
c as (select page_id, html, md5(html) as tag, concat(regexp_replace(regexp_replace(lower(host), '^www[0-9]*\.', ''), ':(80|443)$', ''),
    regexp_replace(regexp_replace(rest, '\?.*$', ''), '/+$', ''), case when kept <> '' then '?' || kept else '' end) as canon from r),
m as (select a.page_id, a.tag, max(b.page_id) as source_page_id from c a left join c b on a.canon = b.canon and
    (b.page_id * 60 < a.page_id * 60 + 86400 or b.page_id * 60 = a.page_id * 60 + 86400 and b.page_id * 2 < a.page_id * 2 + 1) group by a.page_id, a.tag)
select m.page_id, m.source_page_id,
  case when m.source_page_id is null then 'orphan' when m.tag = s.tag then 'resolved' else 'mismatch' end as outcome,
  case when m.tag = s.tag then s.tag end as payload_md5,
  case when m.tag = s.tag then cast(length(s.html) as bigint) end as payload_chars,
  case when m.tag = s.tag then 'age=9;content-type=text/html;etag="' || m.tag || '"' end as headers
from m left join c s on s.page_id = m.source_page_id
"""
