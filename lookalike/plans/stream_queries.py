"""Queries over the log of filesystem events, as a table and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lookalike.operators import clustering, ingest
from lookalike.plans import tables as t
from lookalike.session import shared_dir
from lookalike.streaming import events

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {t.EVENTS} SELECT epoch_us(ts) // 1000000 * 1000000 AS at, path, kind AS event_type, count(*) AS events FROM ev WHERE ts IS NOT NULL GROUP BY 1, 2, 3")
def fs_coalesced(spark, d):
    return events.coalesced(t.table(spark, d, "fs_log"))


@query(f"WITH {t.LAST} SELECT path, kind AS event_type, lastev.at FROM lastev")
def fs_last_states(spark, d):
    return events.last_states(t.table(spark, d, "fs_log"))


@query(f"WITH {t.LAST} SELECT path FROM gone")
def fs_removed(spark, d):
    return events.removed(t.table(spark, d, "fs_log"))


@query(f"WITH {t.EVENTS} SELECT epoch_us(ts) // 3600000000 * 3600000000 AS at, kind AS event_type, count(*) AS events FROM ev WHERE ts IS NOT NULL GROUP BY 1, 2")
def fs_hourly(spark, d):
    """Event-time windows over the log; an extension, as the reference has none."""
    rows = events.windowed(t.table(spark, d, "fs_log"), window="1 hour")
    return rows.select(F.unix_micros("w.start").alias("at"), "event_type", "events")


def _streamed(spark, d, write):
    """Run a stream over the event files until all are read; the folder it wrote, as a table."""
    base = f"{shared_dir(spark)}/lookalike/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"
    source = events.read(spark, f"{d}/fs_log.parque[t]")  # a pattern, so that one file will do as well as a folder
    write(source, base).awaitTermination()
    return base


@query(f"WITH {t.CUR}, {t.LAST} SELECT DISTINCT path, mode FROM cur WHERE path NOT IN (SELECT path FROM gone)")
def fs_stream_prune(spark, d):
    """The catalog after a stream of events pruned it: a path whose last event took it away is gone."""

    def write(source, base):
        apply = lambda rows, number: rows.write.mode("overwrite").parquet(f"{base}/states/batch={number}")
        return events.prune(source, apply, f"{base}/checkpoint")

    states = spark.read.schema("path string, event_type string, at bigint, got bigint, batch int").parquet(_streamed(spark, d, write) + "/states")
    gone = events.gone(states)
    return ingest.delete(t.current(spark, d, ["size"], None), gone).select("path", "mode")


@query(
    f"""WITH {t.EVENTS}, s AS (SELECT path, ts, kind, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, kind) < INTERVAL 90 SECOND THEN 0 ELSE 1 END AS new FROM ev WHERE ts IS NOT NULL),
r AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, kind ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT path, epoch_us(min(ts)) AS at, arg_max(kind, (ts, kind)) AS event_type, count(*) AS events FROM r GROUP BY path, run"""
)
def fs_debounced(spark, d):
    return events.debounced(t.table(spark, d, "fs_log"), "90 seconds")


@query(f"WITH {t.CUR}, {t.LAST} SELECT path FROM gone WHERE path NOT IN (SELECT path FROM cur WHERE mode = 'faces')")
def fs_removed_unlisted(spark, d):
    """Files that went away and that a fresh listing doesn't have again."""
    return events.removed(t.table(spark, d, "fs_log"), t.listing(spark, d))


@query()
def fs_stream_windows(spark, d):
    """Windowed counts written by a stream with a watermark; late rows beyond it are dropped.

    Windows that end after the last event less 2 days stay open and are not written."""

    def write(source, base):
        rows = events.windowed(source, late="2 days", window="1 hour").select(F.unix_micros("w.start").alias("at"), "event_type", "events")
        return rows.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start()

    return spark.read.schema("at bigint, event_type string, events bigint").parquet(_streamed(spark, d, write) + "/out")


@query(
    f"""WITH {t.MEM}, {t.LAST}, rest AS (SELECT * FROM mem WHERE path NOT IN (SELECT path FROM gone)), n AS (SELECT cluster_id FROM rest GROUP BY 1 HAVING count(*) > 1)
SELECT (SELECT count(DISTINCT cluster_id) FROM mem) AS clusters_before, (SELECT count(*) FROM n) AS clusters_after, (SELECT count(*) FROM mem) AS files_before,
  (SELECT count(*) FROM rest WHERE cluster_id IN (SELECT cluster_id FROM n)) AS files_after"""
)
def fs_prune_effect(spark, d):
    before = t.members(spark, d)
    after = clustering.pruned(before, events.removed(t.table(spark, d, "fs_log")))
    count = lambda rows, when: rows.agg(F.countDistinct("cluster_id").alias(f"clusters_{when}"), F.count("*").alias(f"files_{when}"), F.lit(1).alias("k"))
    return count(before, "before").join(count(after, "after"), "k").drop("k")
