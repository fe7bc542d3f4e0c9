"""Incremental ingestion: each new file once, merged into an accumulating table; windows over events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.relational import latest_wins
from millrace.session import release, saved
from millrace.sources.sinks import commit_parts, committed, committed_parts


def file_stream(spark: SparkSession, directory: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a directory as a stream, so many per run."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def upsert_stream(stream: DataFrame, path: str, key: Sequence[str], version: Sequence[str], checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Merge everything new into the table at ``path``, latest version of each key; ends when caught up.

    The table lies in buckets by key; a batch reads and writes those it touches, and one commit puts
    them all in place. A batch that is run again after a failure merges to the same table, so the
    result is exact. Read it with ``sinks.committed``.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = saved(batch.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "upsert-batch")
        touched = {str(r[0]) for r in new.select("_bucket").distinct().collect()}
        held = sorted(touched & committed_parts(spark, path))
        rows = new.drop("_bucket")
        merged = latest_wins(committed(spark, path, held).select(*rows.columns) if held else rows.limit(0), rows, key, version)
        directory = f"v-{uuid.uuid4().hex}"
        merged.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{directory}")
        if touched:
            commit_parts(spark, path, {b: f"{directory}/_bucket={b}" for b in touched})
        release(new)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, at: str, width: str = "1 day", late: str = "2 hours", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Events counted and ``value`` summed in tumbling windows, late ones up to the watermark; batch or stream."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias(value)).select(F.col("window.start").alias("start"), *by, "n", value)


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed by a gap; batch or stream."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(user, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _seen(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    known = set(state.get[0]) if state.exists else set()
    for b in batches:
        for repo in b["repo_id"]:
            if len(known) < 3:
                known.add(int(repo))
    state.update((sorted(known),))
    yield pd.DataFrame({"key": [key[0]], "shared": [len(known)]})


def shared_values(stream: DataFrame) -> DataFrame:
    """I8: ``key, shared`` for each value key as repositories come in; from three on it is shared.

    The state of a key holds three repositories at most. ``stream`` has ``key, repo_id``.
    """
    return stream.groupBy("key").applyInPandasWithState(_seen, "key string, shared long", "repos array<long>", "update", "NoTimeout")
