"""Feedback and listen streams. Watermarks need an instant, so zoneless times are read as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.FEEDBACK).json(path)


def timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """``events`` with an instant as ``time``, and with a watermark if they are a stream and ``late`` is given. A stream has one
    watermark: pass ``late=None`` for what already has one (after ``once``)."""
    rows = events if dict(events.dtypes)[time] == "timestamp" else events.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late) if rows.isStreaming and late else rows


def once(events: DataFrame, keys: list[str], time: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Events less those repeated within the watermark."""
    rows = timed(events, time, late)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def feedback_windows(events: DataFrame, width: str = "1 day", late: str | None = "1 hour", time: str = "created_at") -> DataFrame:
    """Actions in each tumbling window: events, those "interested", and their share. Works on streams and tables alike."""
    counted = timed(events, time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("events"), F.count_if(F.col("action") == "interested").alias("interested"), F.count_if(F.col("action") == "not_for_me").alias("not_for_me"))
    return counted.select(F.col("window.start").alias("start"), "events", "interested", "not_for_me", (F.col("interested") / F.col("events")).alias("interest_rate"))


#: Reactions to a shown card, and what a viewer does with it.
ACTIONS = ("known", "interested", "not_for_me", "opened", "clicked")


def feedback_rates(events: DataFrame, by: str = "model_version", width: str | None = None, late: str | None = "1 hour", time: str = "created_at") -> DataFrame:
    """Share of each action among the events of a model version; in each tumbling window where ``width`` is given, which a stream
    in append mode needs."""
    keys = [by] if width is None else [by, F.window(time, width).alias("window")]
    rows = events if width is None else timed(events, time, late)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("events"), *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])
    start = [] if width is None else [F.col("window.start").alias("start")]
    return counted.select(by, *start, "events", *[(F.col(a) / F.col("events")).alias(f"{a}_rate") for a in ACTIONS])


def listen_sessions(listens: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, artists): the artists of each session, from a stream or a table of (user_id, artist_id, ts)."""
    grouped = timed(listens, "ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set("artist_id")).alias("artists"), F.count("*").alias("listens"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "artists", "listens")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True):
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
