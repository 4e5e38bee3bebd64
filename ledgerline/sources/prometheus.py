"""Metrics in the Prometheus text format as a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(\d+))?\s*$"


def scrape(spark: SparkSession, path: str) -> DataFrame:
    """name, labels (map), value, ts_ms of the samples in text files; lines without
    a number are dropped."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("l")).where("l <> '' and not startswith(l, '#')").where(F.col("l").rlike(_LINE))
    part = lambda i: F.regexp_extract("l", _LINE, i)
    pairs = F.transform(F.regexp_extract_all(part(2), F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), F.lit(0)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, '="(.*)"$', 1).alias("v")))
    number = part(3)
    value = F.when(number == "+Inf", float("inf")).when(number == "-Inf", float("-inf")).otherwise(number.try_cast("double"))
    return rows.select(part(1).alias("name"), F.map_from_entries(pairs).alias("labels"), value.alias("value"), part(4).try_cast("bigint").alias("ts_ms")).where("value is not null")
