"""Benchmark workloads as DataFrames: seeded operation logs and their effect.

Every draw is a hash of (seed, purpose, operation number), so a workload is the
same on any partitioning and after a lost task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import scramble64
from .operators import resolve

THETA = 0.99


@dataclass(frozen=True)
class Profile:
    """Shares of operations in percent, and how keys are chosen."""

    read: int = 0
    update: int = 0
    insert: int = 0
    scan: int = 0
    rmw: int = 0
    distribution: str = "zipfian"


#: The standard mixes of the YCSB core workloads.
PROFILES = {
    "A": Profile(read=50, update=50),
    "B": Profile(read=95, update=5),
    "C": Profile(read=100),
    "D": Profile(read=95, insert=5, distribution="latest"),
    "E": Profile(scan=95, insert=5),
    "F": Profile(read=50, rmw=50),
    "W": Profile(update=100, distribution="uniform"),
}


def uniform(seed: int, purpose: str, i: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash that any engine has."""
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(purpose), i.cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def zeta(spark: SparkSession, n: int, theta: float = THETA) -> float:
    """Sum of i^-theta for i up to n, computed in parallel."""
    return spark.range(1, n + 1).agg(F.sum(F.pow("id", F.lit(-theta)))).first()[0]


def zipfian(u: Column, n: int, zetan: float, theta: float = THETA) -> Column:
    """Rank from 0 of a zipfian draw by the inversion of Gray and others (1994)."""
    zeta2 = 1 + 0.5**theta
    eta = (1 - (2.0 / n) ** (1 - theta)) / (1 - zeta2 / zetan)
    tail = F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * u - F.lit(eta) + 1, F.lit(1 / (1 - theta))))
    return F.when(u * zetan < 1, 0).when(u * zetan < zeta2, 1).otherwise(F.least(tail, F.lit(n - 1)))


def scrambled_zipfian(u: Column, n: int, zetan: float) -> Column:
    """Zipfian ranks scattered over the key space."""
    return scramble64(zipfian(u, n, zetan).cast("long")) % n


def power_law(u: Column, n: int, s: float = 1.01) -> Column:
    """Inverse of a continuous power law with exponent s on [1, n], from 0."""
    return F.least(F.lit(n - 1), F.floor(F.pow((F.lit(float(n)) ** (1 - s) - 1) * u + 1, F.lit(1 / (1 - s)))) - 1)


def log_uniform(u: Column, n: int) -> Column:
    return F.least(F.lit(n - 1), F.floor(F.pow(F.lit(float(n)), u)) - 1)


def latest(u: Column, n: int) -> Column:
    """Near the newest record: its number less an exponential draw."""
    return F.greatest(F.lit(0), F.lit(n - 1) - F.floor(-F.log(1 - u) * n * 0.01))


def key_of(i: Column) -> Column:
    return F.format_string("usertable:user%010d", i.cast("long"))


def preload(spark: SparkSession, records: int, value_bytes: int = 100, seed: int = 42) -> DataFrame:
    """The loaded table: one entry for each record."""
    text = F.substring(F.repeat(F.sha2(F.concat(F.lit(str(seed)), F.col("id")), 256), -(-value_bytes // 64)), 1, value_bytes)
    return spark.range(records).select(key_of(F.col("id")).alias("key"), text.cast("binary").alias("value"), (F.col("id") + 1).alias("version"), F.lit(False).alias("tombstone"), F.col("id").alias("seq"))


def operations(spark: SparkSession, profile: Profile, records: int, ops: int, seed: int = 42) -> DataFrame:
    """op_id, op, record, key of a timed mix over ``records`` loaded records."""
    rows = spark.range(ops).withColumnRenamed("id", "op_id")
    share = uniform(seed, "op", F.col("op_id")) * 100
    upto, op = 0, F.lit("read")
    for name in ("rmw", "scan", "insert", "update", "read"):
        p = getattr(profile, name)
        op = F.when((share >= upto) & (share < upto + p), name).otherwise(op)
        upto += p
    u = uniform(seed, "key", F.col("op_id"))
    if profile.distribution == "uniform":
        record = F.floor(u * records)
    elif profile.distribution == "latest":
        record = latest(u, records)
    else:
        record = scrambled_zipfian(u, records, zeta(spark, records))
    rows = rows.withColumn("op", op).withColumn("record", record.cast("long"))
    rows = rows.withColumn("record", F.when(F.col("op") == "insert", F.col("op_id") + records).otherwise(F.col("record")))
    return rows.withColumn("key", key_of(F.col("record")))


def writes_of(oplog: DataFrame, base_version: int, value_bytes: int = 100) -> DataFrame:
    """The mutations of an operation log, to append to the table's log."""
    own = oplog.where(F.col("op").isin("update", "insert", "rmw"))
    text = F.substring(F.repeat(F.sha2(F.concat(F.lit("op"), F.col("op_id")), 256), -(-value_bytes // 64)), 1, value_bytes)
    return own.select("key", text.cast("binary").alias("value"), (F.col("op_id") + 1 + base_version).alias("version"), F.lit(False).alias("tombstone"), (F.col("op_id") + base_version).alias("seq"))


def run(loaded: DataFrame, oplog: DataFrame, scan_length: int = 10) -> DataFrame:
    """op, n, found: reads, read-modify-writes and scans against the final
    state. A scan reads ``scan_length`` consecutive records."""
    top = loaded.agg(F.max("version")).first()[0] or 0
    state = resolve.live(loaded.unionByName(writes_of(oplog, top))).select("key", F.lit(1).alias("_hit"))
    wide = F.when(F.col("op") == "scan", F.sequence(F.col("record"), F.col("record") + (scan_length - 1))).otherwise(F.array("record"))
    asked = oplog.select("op", F.explode(wide).alias("record")).withColumn("key", key_of(F.col("record")))
    return asked.join(state, "key", "left").groupBy("op").agg(F.count("*").alias("n"), F.count("_hit").alias("found"))
