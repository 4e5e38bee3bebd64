"""The reference relations of the query suite, derived from the star-schema and
event tables (one definition for Spark, one in SQL for the oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW_NS = 1_706_659_200_000_000_000  # 2024-01-31T00:00:00Z
DAY_NS = 24 * 3600 * 10**9
NODES = ["node-1", "node-2", "node-3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of 'user:<id>' keys; an "error" event is a delete."""
    return timed_events(spark, sf_dir).select(
        F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("props").alias("value"), (F.col("event_id") + 1).alias("version"),
        (F.col("ts_us") * 1000).alias("ts_ns"), (F.col("event_type") == "error").alias("tombstone"), F.col("event_id").alias("seq"),
        F.concat(F.lit("node-"), F.col("event_id") % 3 + 1).alias("node"),
    )


ENTRIES = """entries AS (
  SELECT 'user:' || user_id AS key, props AS value, event_id + 1 AS version, epoch_us(ts) * 1000 AS ts_ns,
    event_type = 'error' AS tombstone, event_id AS seq, 'node-' || (event_id % 3 + 1) AS node FROM events
)"""
WINNERS = """winners AS (
  SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, ts_ns DESC, seq DESC, node DESC) = 1
), live AS (SELECT * FROM winners WHERE NOT tombstone)"""


def clocked(spark: SparkSession, sf_dir: str, local: bool = False) -> DataFrame:
    """Entries with a clock: a key's writes by node so far; with ``local`` only
    those of the entry's own node, so that nodes are concurrent."""
    out = entries(spark, sf_dir)
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    pairs = [x for n in NODES for x in (F.lit(n), F.sum(F.when(F.col("node") == n, 1).otherwise(0)).over(w))]
    out = out.withColumn("vclock", F.map_filter(F.create_map(*pairs), lambda _, v: v > 0))
    return out.withColumn("vclock", F.map_filter("vclock", lambda k, _: k == F.col("node"))) if local else out


CLOCKS = """counts AS (
  SELECT e.*, n.name AS clock_node, sum(CASE WHEN e.node = n.name THEN 1 ELSE 0 END) OVER (PARTITION BY key, n.name ORDER BY seq) AS counter
  FROM entries e, (VALUES ('node-1'), ('node-2'), ('node-3')) n(name)
)"""


def replica_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each replica of a three-node ring holds: some lost, some stale."""
    from ..operators.ring import Ring, replicas

    out = replicas(entries(spark, sf_dir), Ring(NODES), 3).withColumnRenamed("node", "replica")
    return out.where(F.col("seq") % 7 != F.col("replica_index")).where(F.col("seq") % 11 != F.col("replica_index"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_events(spark, sf_dir).select(F.col("event_type").alias("operation"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("latency_ms"), "ts_us", F.col("event_id").alias("seq"))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_events(spark, sf_dir).select(F.concat(F.lit("node-"), F.col("user_id") % 5).alias("node"), "ts_us", F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"))


def ttl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = entries(spark, sf_dir)
    return own.select("key", "seq", (F.col("ts_ns") + F.col("seq") % 30 * DAY_NS).alias("expire_at_ns"), F.col("tombstone").alias("is_tombstone"))


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a bulk load with repeated keys."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("order:"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0")).alias("key"), F.col("l_linenumber").cast("long").alias("version"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ship_us"), "l_partkey")


#: CRC-32 of ASCII keys in SQL: the table from its rule, then a fold over bytes.
CRC = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
)"""


def crc_of(text: str) -> str:
    """SQL for the CRC-32 of a text column where crc_table is joined in."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def ring_sql(nodes: list[str], name: str) -> str:
    """CTEs <name>_at (h, node) and <name>_seg (h, owner) of a ring."""
    values = ", ".join(f"('{n}', {i})" for i, n in enumerate(nodes))
    return f"""{name}_at AS (
  SELECT h, arg_max(node, o) AS node FROM (
    SELECT node, o, {crc_of("node || '#vnode' || v")} AS h FROM (VALUES {values}) n(node, o), range(150) r(v), crc_table) GROUP BY h
)"""
