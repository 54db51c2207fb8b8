"""A change log as a stream: micro-batches into a store, each applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.store import Store

LOG = "id string, seq long, op string, props map<string,variant>"


def read_log(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def apply(stream: DataFrame, store: Store, checkpoint: str, *, compact_every: int = 0, trigger: dict | None = None) -> StreamingQuery:
    """Appends every micro-batch to the store. A batch that is tried again after a failure is known by its number and
    skipped; every `compact_every` batches the store is flushed and, if due, tables of like size are merged."""

    def one(batch: DataFrame, number: int) -> None:
        if store.append(batch, number) and compact_every and (number + 1) % compact_every == 0:
            store.compact("size")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
