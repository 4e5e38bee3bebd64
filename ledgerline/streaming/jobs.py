"""Streaming jobs: log ingestion, replication by micro-batch, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import ENTRY, split_valid
from ..operators import mutate, quorum
from ..operators.ring import Ring, replicas


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The mutation log as a stream; the limit on files is the back-pressure."""
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append valid entries to a log; the sink's own log makes it exactly once."""
    good, _ = split_valid(stream)
    writer = good.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def replicate(stream: DataFrame, ring: Ring, path: str, checkpoint: str, n: int = 3, interval: str | None = None) -> StreamingQuery:
    """The replication queue: each micro-batch is reduced to the last write of a
    key, fanned out to its replicas and written under peer=. A batch that is
    tried again overwrites its own directory, so failures lose nothing."""

    def send(batch: DataFrame, number: int) -> None:
        last = mutate.coalesce_writes(batch)
        rows = replicas(last.drop("node"), ring, n).withColumnRenamed("node", "peer").drop("replica_index")
        rows.repartition("peer").write.mode("overwrite").partitionBy("peer").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def deliver_hints(hints: DataFrame, alive: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write hints of a stream whose targets are back; others stay for a rerun."""

    def send(batch: DataFrame, number: int) -> None:
        quorum.deliverable_hints(batch, alive).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hints.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, operation, n, errors over event time. ``ts`` is cast first: a
    timestamp without a zone cannot carry a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    own = timed.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), "operation").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"))
    return own.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "operation", "n", "errors")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user by gaps in event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    own = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return own.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
