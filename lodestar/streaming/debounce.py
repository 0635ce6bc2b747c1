"""Debounced change events, as a stream and as its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import versions
from ..functions.store import settle


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Structured Streaming: one row per key and session, closed when ``gap`` passes without an event."""
    kept = events.withWatermark(ts, late) if events.isStreaming else events
    out = kept.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("closed_ts"), "n")


def batch_sessions(events: DataFrame, gap_seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same sessions from a table: a new one starts after at least ``gap_seconds`` without an event."""
    w = Window.partitionBy(key).orderBy(ts)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    new = (t - F.lag(t).over(w) >= gap_seconds * 1_000_000) | F.lag(t).over(w).isNull()
    numbered = events.withColumn("session", F.sum(new.cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")).drop("session")


def watch(spark: SparkSession, folder: str, schema: StructType, gap: str, out: str, checkpoint: str) -> None:
    """Runs the stream over all files that are in ``folder`` now and appends closed sessions to ``out``."""
    stream = sessions(spark.readStream.schema(schema).parquet(folder), gap)
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()


def _joined(spans: DataFrame, gap: int) -> DataFrame:
    """Spans (``key, first, last, n``) of a key that lie less than ``gap`` apart as one."""
    w = Window.partitionBy("key").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = spans.withColumn("new", (before.isNull() | (F.col("first") - before >= gap)).cast("int"))
    told = told.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy("key", "session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("session")


def keep_sessions(batch: DataFrame, number: int, root: str, gap_seconds: int, late_seconds: int, key: str = "user_id", ts: str = "ts") -> None:
    """Takes a batch of events into the sessions at ``root``; a batch that was taken before changes nothing.

    Events more than ``late_seconds`` before the latest one of earlier batches are late: they are written beside, under ``late``. Open sessions are
    a table of the published version; those that no event can reach any more are closed, under ``closed``. The version names the last batch, so
    that a batch that fails in between is simply taken again.
    """
    spark, unit = batch.sparkSession, 1_000_000
    at = versions.current(spark, root)
    state = versions.table(spark, at, "state").first() if at else None
    if state is not None and state.batch >= number:
        return
    rows = settle(batch.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")))
    mark = None if state is None or state.seen is None else state.seen - late_seconds * unit
    good = rows if mark is None else rows.where(F.col("t") >= mark)
    late = rows.limit(0) if mark is None else rows.where(F.col("t") < mark)
    # events of one key and instant first, before keys meet
    spans = good.groupBy("key", F.col("t").alias("first")).agg(F.count("*").alias("n")).select("key", "first", F.col("first").alias("last"), "n")
    if at:
        spans = versions.table(spark, at, "open").unionByName(spans)
    merged = settle(_joined(spans, gap_seconds * unit))
    latest = rows.agg(F.max("t")).first()[0]
    seen = max((t for t in (latest, state and state.seen) if t is not None), default=None)
    over = F.col("last") + gap_seconds * unit <= F.lit(seen - late_seconds * unit if seen is not None else None).cast("long")
    merged.where(over).write.mode("overwrite").parquet(f"{root}/closed/batch={number}")
    late.write.mode("overwrite").parquet(f"{root}/late/batch={number}")
    with versions.publish(spark, root) as folder:
        merged.where(~F.coalesce(over, F.lit(False))).write.parquet(f"{folder}/open")
        spark.createDataFrame([(number, seen)], "batch long, seen long").write.parquet(f"{folder}/state")


def kept_sessions(spark: SparkSession, root: str, key: str = "user_id") -> tuple[DataFrame, DataFrame] | None:
    """(sessions ``key, first_ts, last_ts, n, closed``; late events ``key, ts``) of the batches that are published."""
    at = versions.current(spark, root)
    if at is None:
        return None
    number = versions.table(spark, at, "state").first().batch
    columns = "key, first, last, n"
    closed = spark.read.parquet(f"{root}/closed").where(F.col("batch") <= number).select(*columns.split(", "), F.lit(True).alias("closed"))
    told = closed.unionByName(versions.table(spark, at, "open").select(*columns.split(", "), F.lit(False).alias("closed")))
    late = spark.read.parquet(f"{root}/late").where(F.col("batch") <= number)
    return told.select(F.col("key").alias(key), F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), "n", "closed"), late.select(F.col("key").alias(key), F.timestamp_micros("t").alias("ts"))


def debounce(events: DataFrame, root: str, gap_seconds: int, late_seconds: int, checkpoint: str, key: str = "user_id", ts: str = "ts"):
    """Structured Streaming: takes all events that are there now into the sessions at ``root``, batch by batch; the query."""

    def take(batch: DataFrame, number: int) -> None:
        keep_sessions(batch, number, root, gap_seconds, late_seconds, key, ts)

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
