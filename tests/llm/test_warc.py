import gzip
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from graphloom.llm import warc

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id long, kind string, url string, at timestamp, status int, headers map<string,string>, source_id string"


def canon(url):
    bare = url.split("#")[0].split("://", 1)[-1]
    host = bare.split("/")[0].split("?")[0]
    path, _, query = bare[len(host) :].partition("?")
    q = "&".join(sorted(x for x in query.split("&") if x and not x.startswith("utm_")))
    host = host.lower()
    if host.startswith("www."):
        host = host[4:]
    return host.removesuffix(":80").removesuffix(":443") + path.rstrip("/") + ("?" + q if q else "")


def brute(rows):
    full, out = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] and r[3] and r[0] is not None], {}
    for r in rows:
        if r[1] != "revisit" or r[0] is None:
            continue
        before = [f for f in full if r[2] and r[3] and canon(f[2]) == canon(r[2]) and (f[3], f[0]) < (r[3], r[0])]
        if not before:
            out[r[0]] = (None, "orphan", None)
            continue
        f = max(before, key=lambda x: (x[3], x[0]))
        a, b = r[5] or {}, f[5] or {}
        if "etag" in a and "etag" in b:
            same = a["etag"].removeprefix("W/") == b["etag"].removeprefix("W/")
        elif "last-modified" in a and "last-modified" in b:
            same = a["last-modified"] == b["last-modified"]
        else:
            same = None
        outcome = {True: "resolved", False: "mismatch", None: "unproven"}[same]
        merged = {**b, **{k: v for k, v in a.items() if k not in warc.KEPT}} if same else None
        out[r[0]] = (f[0], outcome, merged)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        url = rng.choice(["http://hot.example/", "https://www.HOT.example:443#x", "http://a.example/p?b=2&a=1", "http://a.example/p/?a=1&utm_x=3&b=2", f"http://b.example/{rng.randint(0, 9)}"])
        headers = rng.choice([{}, None, {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "age": str(i)}, {"last-modified": rng.choice("xy"), "content-type": str(i)}])
        rows.append((i, rng.choice(["response", "revisit"]), url, T0 + timedelta(seconds=rng.randint(0, 60)), rng.choice([200, 200, 404]), headers, "x"))
    rows += [(500, "revisit", None, T0, 304, {}, "x"), (501, "revisit", "http://hot.example/", None, 304, {}, "x"), (None, "revisit", "http://hot.example/", T0, 304, {}, "x")]
    df = spark.createDataFrame([(*r[:3], r[3], *r[4:]) for r in rows], SCHEMA)
    for buckets in (1, 7, 64):
        got = {r.id: (r.source_id, r.outcome, r.headers) for r in warc.resolve_revisits(df, buckets=buckets).collect()}
        assert got == brute(rows)
    assert warc.resolve_revisits(df.where("id = -1")).count() == 0


def test_repeated_records_give_one_result(spark):
    rows = [(1, "response", "http://a/", T0, 200, {"etag": "e"}, "x")] * 3 + [(2, "revisit", "http://a/", T0 + timedelta(1), 304, {"etag": "e"}, "x")] * 2
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.id, r.source_id, r.outcome) for r in got] == [(2, 1, "resolved")]


def test_one_row_of_a_repeated_id_counts(spark):
    later = T0 + timedelta(1)
    a, b = (1, "response", "http://a/", T0, 404, {"etag": "x", "age": "1"}, "x"), (1, "response", "http://a/", T0, 200, {"etag": "e", "age": "2"}, "x")
    c, d = (1, "response", "http://a/", T0 - timedelta(1), 200, {"etag": "old"}, "x"), (1, "response", None, later, 200, {"etag": "no"}, "x")
    r, s = (2, "revisit", "http://a/", later, 304, {"etag": "e"}, "x"), (2, "revisit", "http://b/", T0, 304, {"etag": "z"}, "x")
    for rows in ([a, b, c, d, r, s], [s, r, d, c, b, a], [b, r, a, s, d, c]):
        got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert [(x.id, x.source_id, x.outcome, x.headers) for x in got] == [(2, 1, "resolved", {"etag": "e", "age": "2"})]


def test_damaged_files_give_what_is_whole(spark, tmp_path, monkeypatch):
    records = [warc.write_record("response", f"http://{i}/", "2024-01-01T00:00:00Z", f"<urn:{i}>", status=200, payload=random.Random(i).randbytes(3000)) for i in range(5)]
    members = [gzip.compress(r) for r in records]
    bad = bytearray(members[2])
    bad[200:260] = bytes(60)
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*members[:2], bytes(bad), *members[3:4], members[4][:900]]))
    (tmp_path / "b.warc").write_bytes(b"WARC/1.1\r\nContent-Length: x\r\n\r\n" + b"WARC/")
    monkeypatch.setattr(warc, "BATCH", 4000)
    got = {r.record_id: len(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect() if r.record_id}
    assert {k: n for k, n in got.items() if n == 3000}.keys() >= {"<urn:0>", "<urn:1>", "<urn:3>"}


def test_files_round_trip(spark, tmp_path):
    a = warc.write_record("response", "http://a/", "2024-01-01T00:00:00Z", "<urn:1>", status=200, headers={"ETag": '"1"', "X": "y"}, payload=b"<p>\r\n\r\nWARC/1.1 \xff</p>")
    b = warc.write_record("revisit", "http://a/", "2024-01-02T00:00:00Z", "<urn:2>", status=304, headers={"ETag": '"1"'}, profile=warc.PROFILE, refers_to="<urn:1>")
    c = warc.write_record("warcinfo", "", "2024-01-01T00:00:00Z", "<urn:0>", payload=b"software: x")
    (tmp_path / "plain.warc").write_bytes(c + b"junk\r\n" + a)
    (tmp_path / "each.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).orderBy("record_id", F.length("payload")).collect()
    assert [r.warc_type for r in got] == ["warcinfo", "response", "response", "revisit"]
    assert bytes(got[1].payload) == b"<p>\r\n\r\nWARC/1.1 \xff</p>" and got[1].http_status == 200 and got[1].http_headers["etag"] == '"1"'
    assert got[3].http_status == 304 and got[3].profile == warc.PROFILE and got[3].refers_to == "<urn:1>"
    assert list(warc.read_records(a[: len(a) // 2]))[0]["warc_type"] == "response"
