"""What the operators of this subpackage share: tables, materialising and local components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import ensure_checkpoints

#: A word: a letter and the letters and combining marks after it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session's executors, once, so that they need no copy of it."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():  # else it already came as an archive
        path = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
    context._graphloom_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where all runs in one process (tests)."""
    return ensure_checkpoints(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and it survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Removes tables that materialize wrote and nothing reads any more."""
    for df in frames:
        if df is not None and (path := getattr(df, "_graphloom_path", None)):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


_held: dict = {}


def cached(name: str, build):
    """What build() gave the first time in this process; only the last name's is kept, so old models go."""
    if name not in _held:
        _held.clear()
        _held[name] = build()
    return _held[name]


class Held:
    """What build() gives, made once in a Python worker and kept for as long as its tasks need the broadcast of this."""

    def __init__(self, build):
        self.build, self.own = build, None

    def get(self):
        if self.own is None:
            self.own = self.build()
        return self.own


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b): the smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
    return root
