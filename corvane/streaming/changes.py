"""Structured Streaming over change logs and folders of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def change_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of appended parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), *keys, "n")


def debounced(stream: DataFrame, ts: str, key: str, quiet: str, late: str) -> DataFrame:
    """One row per burst of a key's changes once it has been quiet."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, quiet).alias("w"), key).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Each change once: replays of a known change within the watermark are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def latest_per_key(stream: DataFrame, key: str, generation: str) -> DataFrame:
    """(key, generation) whenever a key's highest generation rises; state is one number per key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else -1
        new = max([top, *(int(f[generation].max()) for f in frames if len(f))])
        if new > top:
            state.update((new,))
            yield pd.DataFrame({"key": [k[0]], "generation": [new]})

    return stream.select(key, generation).groupBy(key).applyInPandasWithState(
        step, "key bigint, generation bigint", "generation bigint", "update", GroupStateTimeout.NoTimeout)


def changed_between(log: DataFrame, generation: str, entity: str, since: int, until: int) -> DataFrame | None:
    """Distinct entities of the generations in (since, until]; None, which means rebuild, if one is missing."""
    own = log.filter((F.col(generation) > since) & (F.col(generation) <= until))
    if own.select(generation).distinct().count() != until - since:
        return None
    return own.select(entity).distinct()


def sync_into(stream: DataFrame, log, store, checkpoint: str):
    """Lands each batch in a ``DeliveryLog`` and runs an ``IncrementalStore`` over it.

    A batch's number is the landing's, whatever times its rows carry, so late rows are taken like any others; a batch
    that is delivered again changes no state, and so takes nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            store.run(log, log.append(df))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
