"""Queries over streams: tables that arrive in parts, each read by a new run of the stream from where the last one ended."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import frames as D
from ..sources import store
from ..streaming import frames as ST
from ..streaming import sinks, state
from .registry import query
from .views import frames, table, with_decoded, with_frames
from .window_queries import PRED

#: Longer than any pause of a video, so that only the end of the stream closes it.
QUIET_MS = 1000 * 86_400_000
END = "timestamp '2200-01-01'"


def _arriving(spark, rows, order, make, parts=3):
    """What a stream over rows gives that arrive in parts by the column `order`, and then one row from far ahead
    (END), whose key is NULL, which lets the watermark pass all others. Every part is a run of its own."""
    source, sink, notes = (store.new_path(spark, f"arriving-{k}") for k in ("in", "out", "notes"))
    rows = store.stored(rows.withColumn(order, F.col(order).cast("timestamp")), "arriving")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.unix_micros(order) - F.unix_micros(F.lit(low))) * parts / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1))
    end = rows.limit(1).select(*[F.expr(END).alias(c) if c == order else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    rows.limit(0).write.parquet(source)
    stream = make(spark.readStream.schema(rows.schema).parquet(source))
    for k in range(parts + 1):
        (rows.filter(part == k) if k < parts else end).write.mode("append").parquet(source)
        sinks.start_once(stream, sink, notes).awaitTermination()
    return sinks.read_written(spark, sink, stream.schema)


def _timed(spark, sf):
    """Active frames with the time of their event."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    times = D.positional(e, ["ts", "event_id"], "user_id").select(F.col("user_id").alias("video_id"), F.col("frame_index").cast("long").alias("frame_index"), "ts")
    return D.active(frames(spark, sf), "active").join(times, ["video_id", "frame_index"])


@query("x_stream_of_events", with_frames(f", {PRED} SELECT * FROM p"))
def stream_of_events(spark, sf):
    """The alarm events of w10_events from a stream."""
    rows = _timed(spark, sf).select("video_id", "frame_index", "ts", (F.col("intensity") >= 60).alias("hit"))
    return _arriving(spark, rows, "ts", lambda s: state.event_stream(s, F.col("hit"), "ts", "10 minutes", quiet_ms=QUIET_MS))


@query("m11_stream_of_labels", with_decoded("SELECT * FROM decoded"))
def stream_of_labels(spark, sf):
    """Labels of a stream with a lag beyond the longest segment: those of the whole."""
    rows = _timed(spark, sf).select("video_id", "frame_index", "ts", "p_low", "p_nominal", "p_high")
    out = _arriving(spark, rows, "ts", lambda s: state.label_stream(s, "ts", "10 minutes", lag=5000, quiet_ms=QUIET_MS))
    return out.withColumn("temporal_label", F.col("temporal_label").cast("long"))


@query("x_stream_of_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_of_windows(spark, sf):
    """Hourly counts of a stream with a watermark, each window given once."""
    rows = table(spark, sf, "events").select("ts", "event_type", "value")
    w = _arriving(spark, rows, "ts", lambda s: ST.windowed_counts(s, "ts", "event_type", "1 hour"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", S.rounded(F.col("total"), 4).alias("total"))


@query("x_stream_of_sessions", "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l), g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY 1")
def stream_of_sessions(spark, sf):
    """Sessions of a stream with a watermark."""
    rows = table(spark, sf, "events").select("ts", "user_id")
    s = _arriving(spark, rows, "ts", lambda s: ST.sessions(s, "ts", "user_id", "6 hours"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
