"""A change log and sorted tables under one folder, tied together by numbered versions of a manifest."""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import changelog, storage

EMPTY = {
    "version": 0, "last": -1, "batch": -1, "segments": [], "tables": [],
    "counters": {"flushes": 0, "flushed_entries": 0, "flushed_bytes": 0, "compactions": 0, "tables_in": 0, "tables_out": 0, "bytes_in": 0, "bytes_out": 0},
}
KEPT_VERSIONS = 16


class Store:
    """Writes are log segments; a flush turns segments into a sorted table of level 0, and compaction merges tables.

    Every call reads one version of the manifest and works from that alone. A change of the manifest is a new version,
    which is moved into place only if no other writer has that number yet; else the change is made again on top of the
    newer version. So appends by several writers all count, and an append during a flush or a compaction stays, as these
    take out only the segments and tables they have read. (This needs a file system whose rename without overwriting is
    atomic, as HDFS has; an object store needs one writer at a time.) Folders that no version lists are deleted by age,
    so that a reader of an older version still finds its files.

    Order is by seq alone, also between tables and segments, so that a row may arrive late. A flushed record stands in
    the log as a PUT at its last change: what arrives later with a smaller seq than that is superseded by it. Tombstones
    stay in tables until a compaction of all of them.
    """

    def __init__(self, spark: SparkSession, path: str, fixed: str = ""):
        """fixed: the records' fixed columns as a schema, such as "src string, dst string, type string"."""
        self.spark, self.path = spark, path.rstrip("/")
        more = f", {fixed}" if fixed else ""
        self.schema = f"id string, seq long, op string, props map<string,variant>{more}"
        self.fixed = [x.split()[0] for x in fixed.split(", ") if x]
        self.columns = ["id", "seq", "op", "props", *self.fixed]
        self.table_schema = f"id string, seq long, op string, props map<string,variant>, version long{more}"
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    # -- files
    def _full(self, name: str) -> str:
        return posixpath.join(self.path, name)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._full(name))

    def _fs(self):
        return self._at("x").getFileSystem(self._conf)

    def _read(self, at) -> dict:
        stream = self._fs().open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, found: dict) -> None:
        out = self._fs().create(self._at(name), True)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()

    def _names(self, folder: str) -> dict[str, int]:
        """What is in a folder, with times of change in milliseconds."""
        fs, at = self._fs(), self._at(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(at)} if fs.exists(at) else {}

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    # -- manifest
    def manifest(self) -> dict:
        versions = self._versions()
        return self._read(self._at(f"manifest/{versions[-1]:012d}.json")) if versions else json.loads(json.dumps(EMPTY))

    def commit(self, edit: Callable[[dict], dict | None], tries: int = 100) -> dict | None:
        """Applies edit to the newest version and moves the result into place as the next; None if edit declines."""
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("x").toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        for n in range(tries):
            found = self.manifest()
            new = edit(found)
            if new is None:
                return None
            new = {**new, "version": found["version"] + 1, "updated_at": int(time.time())}
            name, temporary = f"manifest/{new['version']:012d}.json", f"manifest/{uuid.uuid4().hex}.tmp"
            self._write(temporary, new)
            try:
                context.rename(self._at(temporary), self._at(name), none)
                return new
            except Exception as error:  # the number is taken: another writer was first
                self._fs().delete(self._at(temporary), False)
                if not self._fs().exists(self._at(name)):
                    raise error
                time.sleep(0.01 * (n % 10))
        raise RuntimeError(f"no commit after {tries} tries")

    # -- writes
    def append(self, log: DataFrame, batch: int | None = None, *, relative: bool = False) -> bool:
        """Adds log rows (id, seq, op, props, fixed columns) as a segment, with a checksum each.

        A batch number up to the highest one that is in is skipped. relative: the rows' seq counts from 0 and follows
        all that is in the store when the segment is committed.
        """
        if batch is not None and batch <= self.manifest()["batch"]:
            return False
        name = f"log/{uuid.uuid4().hex}"
        changelog.with_checksum(log.select(*self.columns)).write.parquet(self._full(name))
        rows = self.spark.read.schema(self.schema).parquet(self._full(name))
        n, top = rows.agg(F.count("*"), F.coalesce(F.max("seq"), F.lit(-1))).first()

        def edit(found):
            if batch is not None and batch <= found["batch"]:
                return None
            base = found["last"] + 1 if relative else 0
            segment = {"path": name, "base": base, "entries": n, "size": self._size(name)}
            last = max(found["last"], base + top) if n else found["last"]
            return {**found, "segments": [*found["segments"], segment], "last": last, "batch": found["batch"] if batch is None else batch}

        if self.commit(edit) is None:
            self._fs().delete(self._at(name), True)
            return False
        return True

    def _size(self, name: str) -> int:
        return self._fs().getContentSummary(self._at(name)).getLength()

    # -- reads
    def log(self, found: dict | None = None) -> DataFrame:
        """The rows of a version's segments; a row that doesn't match its checksum is an error."""
        found = found or self.manifest()
        by_base: dict[int, list[str]] = {}
        for s in found["segments"]:
            by_base.setdefault(s["base"], []).append(self._full(s["path"]))
        frames = [self.spark.createDataFrame([], self.schema)] if not by_base else []
        for base, paths in by_base.items():
            rows = changelog.verified(self.spark.read.schema(self.schema + ", checksum long").parquet(*paths))
            frames.append(rows.withColumn("seq", F.col("seq") + F.lit(base).cast("long")) if base else rows)
        return reduce(DataFrame.unionByName, frames)

    def tables(self, found: dict | None = None, paths: list[str] | None = None) -> DataFrame:
        """The records and tombstones of a version's tables, the newest of each id."""
        found = found or self.manifest()
        paths = [t["path"] for t in found["tables"]] if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], self.table_schema)
        rows = self.spark.read.schema(self.table_schema).parquet(*map(self._full, paths))
        return changelog.latest(rows, "id", "seq").select(*rows.columns) if len(paths) > 1 else rows

    def _merged(self, found: dict, tables: DataFrame, log: DataFrame) -> DataFrame:
        null = F.lit(None).cast("long")
        return changelog.last_entries(tables.unionByName(log.withColumn("version", null)))

    def state(self) -> DataFrame:
        """The live records: (id, props, version, seq, fixed columns)."""
        found = self.manifest()
        rows = self._merged(found, self.tables(found), self.log(found)) if found["segments"] else self.tables(found)
        return rows.where("op = 'PUT'").select("id", "props", "version", "seq", *self.fixed)

    def get(self, ids: list[str]) -> DataFrame:
        """The live records of a few ids. Tables whose key bounds exclude them all are not opened; in the others the
        filter reaches the scan, whose row groups are sorted and carry bloom filters."""
        found = self.manifest()
        paths = [t["path"] for t in found["tables"] if t["entries"] and any(t["min_key"] <= i <= t["max_key"] for i in ids)]
        rows = [self.spark.read.schema(self.table_schema).parquet(self._full(p)).where(F.col("id").isin(ids)) for p in paths]
        own = reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], self.table_schema)
        own = changelog.latest(own, "id", "seq").select(*own.columns) if len(rows) > 1 else own
        if found["segments"]:
            own = self._merged(found, own, self.log(found).where(F.col("id").isin(ids)))
        return own.where("op = 'PUT'").select("id", "props", "version", "seq", *self.fixed)

    def manifest_table(self, found: dict | None = None) -> DataFrame:
        """The tables of a version: (path, level, size, entries, min_key, max_key)."""
        rows = [tuple(t[c] for c in ("path", "level", "size", "entries", "min_key", "max_key")) for t in (found or self.manifest())["tables"]]
        return self.spark.createDataFrame(rows, storage.MANIFEST)

    def counters(self) -> DataFrame:
        """(counter, n) of flushes and compactions."""
        return self.spark.createDataFrame(sorted(self.manifest()["counters"].items()), "counter string, n long")

    # -- upkeep
    def _table(self, rows: DataFrame, level: int) -> dict:
        name = f"tables/{uuid.uuid4().hex}"
        storage.write_run(rows.select("id", "seq", "op", "props", "version", *self.fixed), self._full(name))
        own = self.spark.read.schema(self.table_schema).parquet(self._full(name))
        n, low, high = own.agg(F.count("*"), F.min("id"), F.max("id")).first()
        return {"path": name, "level": level, "size": self._size(name), "entries": n, "min_key": low, "max_key": high}

    def flush(self) -> bool:
        """Turns the segments into a table of level 0: the records they touch, whole, and tombstones."""
        found = self.manifest()
        if not found["segments"]:
            return False
        log = self.log(found)
        touched = self.tables(found).join(log.select("id").distinct(), "id", "left_semi")
        table = self._table(self._merged(found, touched, log), 0)
        gone, read = {s["path"] for s in found["segments"]}, {t["path"] for t in found["tables"]}

        def edit(now):
            if not gone <= {s["path"] for s in now["segments"]}:
                return None  # another flush took them
            if not read <= {t["path"] for t in now["tables"]} and any(t["path"] not in read and t["level"] == 0 for t in now["tables"]):
                return None  # another flush may have changed the records this one has read
            c = {**now["counters"]}
            c["flushes"] += 1
            c["flushed_entries"] += table["entries"]
            c["flushed_bytes"] += table["size"]
            return {**now, "segments": [s for s in now["segments"] if s["path"] not in gone], "tables": [*now["tables"], table], "counters": c}

        if self.commit(edit) is None:
            self._fs().delete(self._at(table["path"]), True)
            return False
        return True

    def compact(self, policy: str = "full") -> bool:
        """Merges tables into one of the next level. policy: "full" takes all, and only then tombstones go; "size" those
        of `storage.pick_by_size`; "level" those of `storage.pick_level0`; the latter two only if a compaction is due.
        Segments are flushed first."""
        self.flush()
        found = self.manifest()
        listed = self.manifest_table(found)
        if policy == "full":
            paths = [t["path"] for t in found["tables"]]
        else:
            if not storage.due(listed).first()["due"]:
                return False
            paths = [r["path"] for r in (storage.pick_by_size if policy == "size" else storage.pick_level0)(listed).collect()]
        levels = [t["level"] for t in found["tables"] if t["path"] in paths]
        whole = len(paths) == len(found["tables"])
        if not paths or len(paths) == 1 and not whole:
            return False
        rows = self.tables(found, paths)
        table = self._table(rows.where("op <> 'DELETE'") if whole else rows, storage.next_level(levels))
        gone = set(paths)

        def edit(now):
            if not gone <= {t["path"] for t in now["tables"]}:
                return None  # another compaction took one of them
            c = {**now["counters"]}
            c["compactions"] += 1
            c["tables_in"] += len(gone)
            c["tables_out"] += 1
            c["bytes_in"] += sum(t["size"] for t in found["tables"] if t["path"] in gone)
            c["bytes_out"] += table["size"]
            return {**now, "tables": [*(t for t in now["tables"] if t["path"] not in gone), table], "counters": c}

        if self.commit(edit) is None:
            self._fs().delete(self._at(table["path"]), True)
            return False
        self.clean()
        return True

    def clean(self, seconds: float = 86_400) -> list[str]:
        """Deletes folders that the newest version doesn't list and old versions, both only after `seconds`: readers of
        an older version and writers that haven't committed yet keep theirs."""
        found, before, gone = self.manifest(), 1000 * (time.time() - seconds), []
        listed = {x["path"] for x in (*found["segments"], *found["tables"])}
        for folder in ("log", "tables"):
            gone += [n for k, t in self._names(folder).items() if (n := f"{folder}/{k}") not in listed and t < before]
        old = {f"{v:012d}.json" for v in self._versions()[:-KEPT_VERSIONS]}
        gone += [f"manifest/{k}" for k, t in self._names("manifest").items() if (k in old or k.endswith(".tmp")) and t < before]
        for name in gone:
            self._fs().delete(self._at(name), True)
        return gone

    def verify(self) -> list[str]:
        """Listed folders that are not there."""
        found = self.manifest()
        return [x["path"] for x in (*found["segments"], *found["tables"]) if not self._fs().exists(self._at(x["path"]))]

    def checkpoint(self) -> str:
        """A copy of the manifest under a name with its time."""
        name = f"checkpoint-{int(time.time() * 1000)}.json"
        self._write(name, self.manifest())
        return name
