"""Import and export of key-value pairs as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_lines(state: DataFrame) -> DataFrame:
    """One JSON object {key: value} for each entry (column ``line``)."""
    return state.select(F.to_json(F.create_map("key", F.col("value").cast("string"))).alias("line"))


def write_export(state: DataFrame, path: str) -> None:
    export_lines(state).write.mode("errorifexists").text(path)


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """key, value (binary) of JSON objects that map keys to strings; an object
    for each line, or a file that is one object. Lines that aren't are dropped."""
    lines = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null")
    return lines.select(F.explode("m").alias("key", "value")).withColumn("value", F.col("value").cast("binary"))


def read_import_document(spark: SparkSession, path: str) -> DataFrame:
    """The same for files that hold one object over many lines."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null")
    return whole.select(F.explode("m").alias("key", "value")).withColumn("value", F.col("value").cast("binary"))


def bad_lines(spark: SparkSession, path: str) -> int:
    """Lines that read_import() drops: not blank, and not an object of strings."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.from_json("value", "map<string,string>").isNull()).count()
