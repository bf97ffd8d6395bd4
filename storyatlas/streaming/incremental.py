"""Incremental passes over arriving files (extras)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import keep_first
from ..sources.files import exists
from ..sources.store import FAN, Store


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their sum by type and window; state ends ``late`` behind the newest event."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def enrich_arrivals(spark: SparkSession, source: str, schema: str, done_path: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame], key: str = "entry_id"):
    """Enrich what arrives in ``source`` and append it to ``done_path``; a key is enriched once, also after a restart."""
    def batch(rows: DataFrame, _: int) -> None:
        todo = keep_first(rows, [key], sorted(c for c in rows.columns if c != key))  # of rows with one key the least
        if exists(spark, done_path):
            todo = todo.join(spark.read.parquet(done_path).select(key), key, "left_anti")
        enrich(todo).write.mode("append").parquet(done_path)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def enrich_kept(spark: SparkSession, source: str, schema: str, store: Store, kept: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame], key: str = "entry_id", fan: int = FAN):
    """Enrich what arrives in ``source`` and keep it in ``store`` (rows of the schema ``kept``); a key is enriched once.

    A batch that is repeated after a crash finds the keys that were kept before it and adds the others, whether the
    crash came before or after the batch counted; of each batch all rows count or none.  ``enrich`` sees only
    keys that are new and not NULL, of rows with one key the least, and may return several rows for one, or none
    (such a key is asked again if it arrives again).  The store's keys alone are read, and its folders are
    merged as they grow.
    """

    def batch(rows: DataFrame, _: int) -> None:
        todo = keep_first(rows.where(F.col(key).isNotNull()), [key], sorted(c for c in rows.columns if c != key))
        done = store.rows(kept).select(key).distinct()
        store.add(enrich(todo.join(done, key, "left_anti")).select(*names))
        store.compact(kept, key, fan)

    names = spark.createDataFrame([], kept).columns
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
