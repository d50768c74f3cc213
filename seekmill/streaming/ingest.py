"""Incremental ingestion and event streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekmill.operators import lexical
from seekmill.sources.store import Store


def write_chunks(store: Store, batch: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, dead: DataFrame | None = None, add: dict[str, DataFrame] | None = None) -> None:
    """Put a batch of chunks: blank contents and empty ids are left out, a chunk that is there already is replaced, so a
    repeated batch changes nothing. An empty embedding is an error. dead names further keys to delete, add further rows; all in one commit."""
    valid = batch.filter((F.trim(F.coalesce("content", F.lit(""))) != "") & (F.coalesce("chunk_id", F.lit("")) != "")).dropDuplicates(["chunk_id"])
    segment, chunks = store.stage("chunks", valid)
    index = lexical.ordered_index(chunks)
    vector = F.when(F.size("embedding") > 0, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit("a chunk has no embedding")))
    vectors = {"vectors": embed(chunks).select("chunk_id", vector.alias("embedding"))} if embed else {}
    gone = chunks.select("chunk_id")
    store.commit({"chunks": segment, "postings": store.stage("postings", index.postings, ordered=True)[0], "lengths": index.lengths, **vectors, **(add or {})}, dead=gone.union(dead.select("chunk_id")) if dead is not None else gone)


def ingest(stream: DataFrame, store: Store, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None, interval: str | None = None) -> StreamingQuery:
    """A stream of chunks into the store, one commit a micro-batch, every interval (None: what there is, then stop). The stream's
    checkpoint is the write-ahead log; batches are idempotent."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: write_chunks(store, batch, embed)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stream_parquet(spark: SparkSession, source: DataFrame, folder: str, files: int = 4) -> DataFrame:
    """A table as a file stream of several files, one a micro-batch."""
    source.repartition(files).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """J8 over a stream: counts and sums by event-time window and type; windows close behind the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and read its result."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def sessions(events: DataFrame, gap: str = "300 seconds", key: str = "user_id") -> DataFrame:
    """Index streams, idle for longer than gap, are closed: (key, start, end, n)."""
    s = events.groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of every key."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_type", "ts", "event_id"), F.struct("ts", "event_id")).alias("e")).select(key, "e.event_type", "e.ts", "e.event_id")


def event_counters(events: DataFrame) -> DataFrame:
    """Counters by kind."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def politeness(requests: DataFrame, delay: float = 1.0) -> DataFrame:
    """I6 over a log of requests(host, ts): whether each comes at least delay seconds after the host's request before."""
    w = Window.partitionBy("host").orderBy("ts", "request_id")
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))) / 1e6
    return requests.withColumn("elapsed", F.round(elapsed, 3)).withColumn("decision", F.when(F.coalesce(F.col("elapsed") >= delay, F.lit(True)), "allowed").otherwise("wait"))


def progress(query: StreamingQuery) -> dict:
    """{stage, current, total, rate} of a running job."""
    last = query.lastProgress or {}
    return {"stage": query.status["message"], "current": last.get("numInputRows", 0), "batch": last.get("batchId", -1), "rate": last.get("processedRowsPerSecond", 0.0), "active": query.isActive}
