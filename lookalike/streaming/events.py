"""Keeping catalog and result in step with a stream of filesystem events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "ts timestamp, path string, event_type string, received_at timestamp"
KINDS = ["created", "modified", "deleted", "moved", "closed"]
REMOVING = ["deleted", "moved"]


def event_kind(column: str = "event_type") -> Column:
    """The type in plain spelling; null if it is none."""
    k = F.lower(F.trim(F.col(column)))
    return F.when(k.isin(KINDS), k)


def cleaned(events: DataFrame) -> DataFrame:
    """Events of known type on a named path. Works on streams and on tables."""
    return events.withColumn("event_type", event_kind()).where(F.col("path").isNotNull() & F.col("event_type").isNotNull())


def coalesced(events: DataFrame, window: str = "1 second") -> DataFrame:
    """(at, path, event_type, events): repeated events of one path within a window become one.

    On a stream, with a watermark, windows close as event time passes; late rows are dropped then. A path
    with a tenth of all events combines before the shuffle.
    """
    grouped = cleaned(events).groupBy(F.window("ts", window).alias("w"), "path", "event_type").agg(F.count("*").alias("events"))
    return grouped.select(F.unix_micros("w.start").alias("at"), "path", "event_type", "events")


def debounced(events: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """(path, at, event_type, events): of a run of events of one path with less than `gap` between them only the last
    counts. On a stream, with a watermark, a run ends as event time passes."""
    last = F.max_by("event_type", F.struct("ts", "event_type")).alias("event_type")
    runs = cleaned(events).where(F.col("ts").isNotNull()).groupBy(F.session_window("ts", gap).alias("w"), "path").agg(last, F.count("*").alias("events"))
    return runs.select("path", F.unix_micros("w.start").alias("at"), "event_type", "events")


def last_states(events: DataFrame, arrival: bool = False) -> DataFrame:
    """(path, event_type, at[, got]): the last event of each path by time, by arrival, then by type."""
    last = F.max(F.struct(F.unix_micros("ts").alias("at"), F.unix_micros("received_at").alias("got"), "event_type")).alias("e")
    return cleaned(events).where(F.col("ts").isNotNull()).groupBy("path").agg(last).select("path", "e.event_type", "e.at", *(["e.got"] if arrival else []))


def removed(events: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(path): files whose last event took them away, and which a listing, if there is one, doesn't have again."""
    return gone(last_states(events), listing)


def gone(states: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(path): as removed, from states (path, event_type, at) that may come from several batches; the last of each path
    counts, by time, then by arrival where states have it, then by type."""
    order = [c for c in ("at", "got", "event_type") if c in states.columns]
    last = states.groupBy("path").agg(F.max(F.struct(*order)).alias("e")).where(F.col("e.event_type").isin(REMOVING)).select("path")
    return last if listing is None else last.join(listing.select("path"), "path", "left_anti")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event files as they appear in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def windowed(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Event counts by type in event-time windows with a watermark. An extension: the reference has no windows."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    return cleaned(stream).withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("events"))


def deduplicated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, remembering as long as the watermark allows."""
    return cleaned(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "event_type", "ts"])


def prune(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand the last states (path, event_type, at, got) of each micro-batch to `apply`; all that is there, or one batch
    per `every`. A file may go in one batch and come again in another, so `apply` keeps states and `gone` tells
    from all of them what went away.

    The checkpoint remembers what was applied, so a restarted query goes on where it stopped; a batch may
    be applied twice, which does no harm, as a batch is written under its number.
    """
    def batch(rows: DataFrame, number: int) -> None:
        apply(last_states(rows, arrival=True), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
