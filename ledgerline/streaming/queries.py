"""Streaming queries run to completion, for comparison with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import queries as q
from ..plans.scratch import scratch_dir
from . import jobs, processors


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream (the pattern also matches a single file)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


def _drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is there into tables of its micro-batches."""
    spark = stream.sparkSession
    path = scratch_dir(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/out/batch=none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*")


@q.query(q.ORACLES["breaker_states"])
def stream_breaker(spark, d):
    processors.use_rocksdb(spark)
    e = _events(spark, d).select(F.concat(F.lit("node-"), F.col("user_id") % 5).alias("node"), F.col("event_id").alias("seq"), "ts_us", (F.col("event_id") % 4 == 0).alias("ok"))
    return _drain(processors.breaker_stream(e, 5, 600_000_000, 3), "breaker", "append")


@q.query(f"{q.BASE} SELECT key, version, tombstone FROM winners")
def stream_latest(spark, d):
    processors.use_rocksdb(spark)
    e = _events(spark, d).select(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("version"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("tombstone"))
    out = _drain(processors.latest_stream(e), "latest", "update")
    return out.groupBy("key").agg(F.max(F.struct("version", "tombstone")).alias("w")).select("key", "w.version", "w.tombstone")


@q.query("""SELECT epoch_us(ts) // 3600000000 * 3600 AS start_s, event_type AS operation, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL""")
def stream_rates(spark, d):
    e = _events(spark, d).select("ts", F.col("event_type").alias("operation"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    out = _drain(jobs.rates(e, "1 hour"), "rates", "complete")
    return out.select(F.unix_timestamp("start").alias("start_s"), "operation", "n", "errors")


@q.query("""WITH s AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM s)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n FROM r GROUP BY user_id, run""")
def stream_sessions(spark, d):
    out = _drain(jobs.sessions(_events(spark, d), "1 hour"), "sessions", "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


