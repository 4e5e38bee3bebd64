"""Write-ahead logs as JSON lines: replay, count, compact, truncate.

A record is {"op": "PUT" or "DEL", "key", "value" (base64), "ver", "ts" (ns),
"vc"}. Lines that aren't records are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "op string, key string, value string, ver long, ts long, vc map<string,bigint>"
#: Records of a file at most.
SEGMENT = 1 << 16


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log, in the columns of the model; seq is the version."""
    lines = spark.read.text(path).select(F.from_json("value", RECORD).alias("r")).where("r is not null and r.key is not null and r.op in ('PUT', 'DEL')")
    return lines.select(
        "r.key", F.unbase64("r.value").alias("value"), F.col("r.ver").alias("version"), F.col("r.ts").alias("ts_ns"), (F.col("r.op") == "DEL").alias("tombstone"),
        F.col("r.vc").alias("vclock"), F.lit(None).cast("string").alias("node"), F.col("r.ver").alias("seq"),
    )


def append(entries: DataFrame, path: str) -> None:
    """Append entries as JSON lines; clocks are kept. Files are rolled at
    SEGMENT records, as some readers take a file whole."""
    op = F.when(F.coalesce(F.col("tombstone"), F.lit(False)), "DEL").otherwise("PUT")
    clock = F.col("vclock") if "vclock" in entries.columns else F.lit(None).cast("map<string,bigint>")
    out = entries.select(op.alias("op"), "key", F.base64(F.col("value").cast("binary")).alias("value"), F.col("version").alias("ver"), F.col("ts_ns").alias("ts"), clock.alias("vc"))
    out.write.mode("append").option("maxRecordsPerFile", SEGMENT).json(path)


def count(spark: SparkSession, path: str) -> int:
    return replay(spark, path).count()


def max_version(spark: SparkSession, path: str) -> int:
    return replay(spark, path).agg(F.max("version")).first()[0] or 0


def compact(spark: SparkSession, path: str, to: str, after_version: int = -1) -> int:
    """Write the records above a version to a new log; how many were written."""
    return _written(replay(spark, path).where(F.col("version") > after_version), to)


def truncate_before(spark: SparkSession, path: str, to: str, version: int) -> int:
    """Write the records from a version on to a new log; how many were written."""
    return compact(spark, path, to, version - 1)


def newest_only(spark: SparkSession, path: str, to: str) -> int:
    """Write the newest record of each key to a new log; how many there are."""
    from ..operators.resolve import winners

    return _written(winners(replay(spark, path)), to)


def _written(rows: DataFrame, to: str) -> int:
    seen = Observation()
    append(rows.observe(seen, F.count("*").alias("n")), to)
    return seen.get["n"]


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a log on disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def reset(spark: SparkSession, path: str) -> None:
    """Empty a log."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at, True)
    fs.mkdirs(at)


def bad_lines(spark: SparkSession, path: str) -> int:
    """Lines that replay() drops."""
    return spark.read.text(path).where(F.trim("value") != "").count() - count(spark, path)
