"""Queries of writes, stores, logs and their formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merkle, mutate, quorum, resolve, ring
from ..operators.table import KVTable
from ..sources import binary_log, json_map, prometheus, wal
from ..sources import fixtures as fx
from .queries import _FOUR_PREFS, _LEAVES, BASE, FOUR, kv, query
from .scratch import scratch_dir
from .store import Store

_TOP = "(SELECT max(version) FROM entries)"


def _texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.col("value").cast("string"))


@query(f"""WITH {fx.ENTRIES} SELECT 'user:7' AS key, 'fresh' AS value, {_TOP} + 1 AS version, 'node-1=1' AS clock UNION ALL SELECT 'zz:new', 'x', {_TOP} + 2, 'node-9=4'""")
def kv_put(spark, d):
    log = fx.entries(spark, d)
    top = mutate.latest_version(log)
    one = _texts(mutate.put(log, "user:7", b"fresh", "node-1", fx.NOW_NS))
    both = log.unionByName(one, allowMissingColumns=True)
    two = _texts(mutate.put(both, "zz:new", b"x", "node-1", fx.NOW_NS, {"node-9": 4}))
    state = KVTable(both.unionByName(two, allowMissingColumns=True)).scan().where(F.col("version") > top)
    clock = F.array_join(F.transform(F.map_entries("vclock"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return state.select("key", "value", "version", clock.alias("clock"))


@query(f"""WITH {fx.ENTRIES} SELECT key, n.name AS node, count(*) FILTER (node = n.name) + CASE WHEN n.name = 'node-2' THEN 1 ELSE 0 END AS counter
FROM entries, (VALUES ('node-1'), ('node-2'), ('node-3')) n(name) GROUP BY key, n.name HAVING count(*) FILTER (node = n.name) > 0 OR n.name = 'node-2'""")
def kv_put_clocked(spark, d):
    log = fx.clocked(spark, d)
    rows = mutate.advance_clocks(log, log.select("key").distinct().withColumn("value", F.lit("w")), "node-2")
    return rows.select("key", F.explode("vclock").alias("node", "counter"))


_BATCH = "batch AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 50 = 3 THEN '' ELSE 'cust:' || (c_custkey % 100) END AS key, c_name AS value FROM customer)"


def _batch(spark, d):
    k = F.col("c_custkey")
    key = F.when(k % 50 == 3, "").otherwise(F.concat(F.lit("cust:"), k % 100))
    return fx.table(spark, d, "customer").select(k.alias("pos"), key.alias("key"), F.col("c_name").alias("value"))


@query(f"WITH {fx.ENTRIES}, {_BATCH} SELECT key, value, {_TOP} + 1 + pos AS version, 'ok' AS outcome FROM (SELECT * FROM batch WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1) UNION ALL SELECT key, value, NULL, 'empty key' FROM batch WHERE key = ''")
def kv_batch_put(spark, d):
    rows, bad = mutate.batch_put(fx.entries(spark, d), _batch(spark, d), "node-1", fx.NOW_NS)
    refused = bad.select("key", "value", F.lit(None).cast("long").alias("version"), F.col("reason").alias("outcome"))
    return rows.select("key", "value", "version", F.lit("ok").alias("outcome")).unionAll(refused)


@query("SELECT 'whole' AS batch, (SELECT count(*) FROM nation) AS applied, 0::BIGINT AS errors, (SELECT count(*) FROM nation) AS written UNION ALL SELECT 'spoilt', 0, (SELECT count(*) FROM nation), 0")
def kv_batch_request(spark, d):
    log, out = fx.entries(spark, d), None
    for name, key in (("whole", F.col("n_name")), ("spoilt", F.when(F.col("n_nationkey") == 3, "").otherwise(F.col("n_name")))):
        batch = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), key.alias("key"), F.lit("v").alias("value"))
        rows, answer = mutate.request_batch(log, batch, "node-1", fx.NOW_NS)
        own = answer.crossJoin(rows.agg(F.count("*").alias("written"))).select(F.lit(name).alias("batch"), "applied", "errors", "written")  # one row each
        out = own if out is None else out.unionAll(own)
    return out


_ASKED = "asked AS (SELECT 'user:' || (i * 3) AS key FROM range(200) r(i))"


def _asked(spark):
    return spark.range(200).select(F.concat(F.lit("user:"), F.col("id") * 3).alias("key"))


def _deleted(spark, d, strict):
    rows, missing = mutate.delete(fx.entries(spark, d), _asked(spark), "node-1", fx.NOW_NS, strict)
    gone = missing.select("key", F.lit("missing").alias("kind"), F.lit(None).cast("long").alias("version"))
    return rows.where("tombstone").select("key", F.lit("tombstone").alias("kind"), "version").unionAll(gone)


@query(f"{BASE}, {_ASKED} SELECT key, 'tombstone' AS kind, {_TOP} + 1 AS version FROM asked UNION ALL SELECT key, 'missing', NULL FROM asked WHERE key NOT IN (SELECT key FROM live)")
def kv_delete_blind(spark, d):
    return _deleted(spark, d, False)


@query(f"{BASE}, {_ASKED} SELECT key, 'tombstone' AS kind, {_TOP} + 1 AS version FROM asked WHERE key IN (SELECT key FROM live) UNION ALL SELECT key, 'missing', NULL FROM asked WHERE key NOT IN (SELECT key FROM live)")
def kv_delete_strict(spark, d):
    return _deleted(spark, d, True)


@query(f"{BASE}, {_ASKED} SELECT key, version FROM live WHERE key NOT IN (SELECT key FROM asked)")
def kv_delete_effect(spark, d):
    log = fx.entries(spark, d)
    rows, _ = mutate.delete(log, _asked(spark), "node-1", fx.NOW_NS)
    return KVTable(log.unionByName(_texts(rows), allowMissingColumns=True)).scan().select("key", "version")


@query(f"{BASE} SELECT key, {_TOP} + 5 AS version FROM live WHERE length(key) = 6 UNION ALL SELECT key, version FROM live WHERE length(key) <> 6")
def kv_overlay(spark, d):
    """Unlogged writes on top of a table."""
    t = kv(spark, d)
    rows = t.scan().where(F.length("key") == 6).withColumns({"version": F.lit(mutate.latest_version(t.log) + 5).cast("long"), "value": F.lit("soft")})
    return t.overlay(rows).scan().select("key", "version")


# replicated writes

_SENT = f"""WITH {fx.ENTRIES}, {_FOUR_PREFS}, w AS (SELECT key, max(version) AS version FROM entries GROUP BY key), dead AS (SELECT key FROM prefs WHERE node = 'node-2' AND i < 3),
sent AS (
  SELECT w.key, w.version, p.node AS replica, CASE WHEN p.i < 3 THEN NULL ELSE 'node-2' END AS target, NOT (p.node = 'node-3' AND w.version % 5 = 0) AS ok
  FROM w JOIN prefs p USING (key) WHERE p.node <> 'node-2' AND (p.i < 3 OR w.key IN (SELECT key FROM dead))
)"""


def _fan_out(spark, d, sloppy=True):
    rows = fx.entries(spark, d).groupBy("key").agg(F.max("version").alias("version"))
    failed = rows.where("version % 5 = 0").select("key", F.lit("node-3").alias("replica"))
    return quorum.fan_out(rows, ring.Ring(FOUR), ["node-1", "node-3", "node-4"], failed=failed if sloppy else None, sloppy=sloppy)


@query(f"{_SENT} SELECT key, version, replica, target, ok FROM sent")
def replicated_put(spark, d):
    return _fan_out(spark, d)[0].select("key", "version", "replica", "target", "ok")


@query(f"{_SENT} SELECT key, count(*) FILTER (ok) AS acks, count(*) FILTER (ok) >= 2 AS committed FROM sent GROUP BY key")
def replicated_put_acks(spark, d):
    return _fan_out(spark, d)[1]


@query(f"{_SENT} SELECT key, version, replica AS target_node FROM sent WHERE NOT ok AND target IS NULL")
def replicated_put_hints(spark, d):
    return _fan_out(spark, d)[2].select("key", "version", "target_node")


@query(f"WITH {fx.ENTRIES}, {_FOUR_PREFS} SELECT key, node AS replica, node <> 'node-2' AS ok FROM prefs WHERE i < 3")
def replicated_delete(spark, d):
    return _fan_out(spark, d, sloppy=False)[0].select("key", "replica", "ok")


@query(f"WITH {fx.ENTRIES}, {_FOUR_PREFS} SELECT key, node AS target_node FROM prefs WHERE i < 3 AND node = 'node-2'")
def replicated_delete_hints(spark, d):
    return _fan_out(spark, d, sloppy=False)[2].select("key", "target_node")


# stores


def _store(spark: SparkSession, d: str, compact: bool = True) -> Store:
    """Events in three epochs, the first two of them merged."""
    store, log = Store(spark, scratch_dir(spark, "store")), fx.entries(spark, d)
    third = log.agg(F.max("seq")).first()[0] // 3 + 1
    for i in range(3):
        store.append(log.where(F.expr(f"seq div {third} = {i}")))
        if i == 1 and compact:
            store.compact(fx.NOW_NS)
    return store


_EPOCH = "seq // ((SELECT max(seq) FROM entries) // 3 + 1)"
_OLD = f"old AS (SELECT * FROM entries WHERE {_EPOCH} < 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1), snap AS (SELECT * FROM old WHERE NOT (tombstone AND {fx.NOW_NS} - ts_ns > {fx.DAY_NS}))"


@query(f"{BASE} SELECT key, value, version FROM live")
def store_read(spark, d):
    return _texts(_store(spark, d).table().scan().select("key", "value", "version"))


@query(f"{BASE} SELECT key, value, version FROM live WHERE key LIKE 'user:2%'")
def store_read_prefix(spark, d):
    return _texts(_store(spark, d, compact=False).table().scan("user:2").select("key", "value", "version"))


@query(f"WITH {fx.ENTRIES}, {_OLD} SELECT key, version, tombstone, 'snapshot' AS level FROM snap UNION ALL SELECT key, version, tombstone, 'log' FROM entries WHERE {_EPOCH} = 2")
def store_levels(spark, d):
    """What a read sees after a merge: the snapshot, and the epoch behind it."""
    level = F.when(F.input_file_name().contains("/snapshot/"), "snapshot").otherwise("log")
    return _store(spark, d).entries().select("key", "version", "tombstone", level.alias("level"))


@query(f"WITH {fx.ENTRIES}, {_OLD}, x AS (SELECT key, value, 'snapshot' AS level FROM snap UNION ALL SELECT key, value, 'log' FROM entries WHERE {_EPOCH} = 2) SELECT level, count(*) AS entries, CAST(sum(strlen(key) + strlen(coalesce(value, ''))) AS BIGINT) AS bytes, true AS has_files FROM x GROUP BY level")
def store_stats(spark, d):
    return _store(spark, d).stats().select("level", "entries", "bytes", (F.col("files") > 0).alias("has_files"))


@query(f"WITH {fx.ENTRIES} SELECT key, version FROM entries WHERE {_EPOCH} >= 1")
def store_changes(spark, d):
    return _store(spark, d, compact=False).entries(since_epoch=1).select("key", "version")


@query(f"WITH {fx.ENTRIES} SELECT {_TOP} AS last_version, 2::BIGINT AS deleted, '3' AS epochs, '2' AS snapshots, true AS has_size")
def store_truncate(spark, d):
    store = _store(spark, d)
    gone = store.truncate()
    names = [",".join(map(str, x)) for x in (store.epochs(), store.snapshots())]
    return spark.createDataFrame([(store.last_version(), gone, *names, store.size() > 0)], "last_version long, deleted long, epochs string, snapshots string, has_size boolean")


@query(f"{BASE} SELECT key, value, version FROM live WHERE key NOT IN ('user:1', 'user:2') UNION ALL SELECT 'user:1', 'again', {_TOP} + 2")
def store_put_delete(spark, d):
    store = _store(spark, d)
    store.delete("user:2", "node-1", fx.NOW_NS)
    store.put("user:1", b"again", "node-1", fx.NOW_NS)
    return _texts(store.table().scan().select("key", "value", "version"))


# logs and files


def _json_log(spark, d) -> str:
    path = scratch_dir(spark, "wal")
    wal.append(fx.entries(spark, d), path)
    return path


@query(f"WITH {fx.ENTRIES} SELECT key, value, version, ts_ns, tombstone FROM entries")
def log_replay(spark, d):
    return _texts(wal.replay(spark, _json_log(spark, d))).select("key", "value", "version", "ts_ns", "tombstone")


@query(f"{BASE} SELECT count(*) AS n, max(version) AS last, count(*) FILTER (version > 500) AS compacted, count(*) FILTER (version >= 900) AS truncated, (SELECT count(*) FROM winners) AS newest, 2::BIGINT AS bad, true AS has_size, 0::BIGINT AS after_reset FROM entries")
def log_maintenance(spark, d):
    path = _json_log(spark, d)
    spark.createDataFrame([("{torn",), ("[]",)], "value string").write.mode("append").text(path)
    to = lambda name: scratch_dir(spark, name)
    row = [wal.count(spark, path), wal.max_version(spark, path), wal.compact(spark, path, to("compact"), 500), wal.truncate_before(spark, path, to("cut"), 900), wal.newest_only(spark, path, to("newest")), wal.bad_lines(spark, path), wal.size(spark, path) > 0]
    wal.reset(spark, path)
    return spark.createDataFrame([(*row, wal.count(spark, path))], "n long, last long, compacted long, truncated long, newest long, bad long, has_size boolean, after_reset long")


def _blobs(spark, d) -> DataFrame:
    file = F.concat(F.lit("f"), F.col("seq") % 4)
    return binary_log.blobs(fx.entries(spark, d).withColumn("file", file))


_BINARY = f"WITH {fx.ENTRIES} SELECT key, coalesce(value, '') AS value, version, ts_ns, tombstone, 'f' || (seq % 4) AS file, row_number() OVER (PARTITION BY seq % 4 ORDER BY seq) - 1 AS place FROM entries"


def _parsed(rows: DataFrame) -> DataFrame:
    return _texts(rows).select("key", "value", "version", "ts_ns", "tombstone", "file", "place")


@query(_BINARY)
def log_binary_torn(spark, d):
    """Binary logs that end in half a record."""
    torn = _blobs(spark, d).withColumn("content", F.concat("content", F.substring("content", 1, 11)))
    return _parsed(binary_log.entries_of(torn, binary_log.any_records))


@query(_BINARY)
def log_binary_resync(spark, d):
    """Binary logs that begin with damage."""
    hurt = _blobs(spark, d).withColumn("content", F.concat(F.unhex(F.lit("ffffffff00ff")), "content"))
    return _parsed(binary_log.entries_of(hurt, lambda data: binary_log.any_records(data, resync=True)))


@query(f"WITH {fx.ENTRIES} SELECT key, coalesce(value, '') AS value, version, tombstone FROM entries")
def log_formats(spark, d):
    """Logs of JSON lines, through the reader that tells formats apart."""
    return _texts(binary_log.read_log(spark, f"{_json_log(spark, d)}/*.json")).select("key", "value", "version", "tombstone")


@query(f"{BASE} SELECT key, value FROM live")
def json_round_trip(spark, d):
    path = scratch_dir(spark, "export")
    json_map.write_export(kv(spark, d).scan(), path)
    spark.createDataFrame([("no object",), ("",)], "value string").write.mode("append").text(path)
    assert json_map.bad_lines(spark, path) == 1
    return _texts(json_map.read_import(spark, path))


@query("SELECT 'ops_total' AS name, event_type AS operation, count(*)::DOUBLE AS value, 1700000000000 AS ts_ms FROM events GROUP BY event_type UNION ALL SELECT 'up', NULL, 1.0::DOUBLE, NULL")
def metrics_scrape(spark, d):
    path = scratch_dir(spark, "metrics")
    n = fx.timed_events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    line = F.format_string('ops_total{operation="%s"} %d 1700000000000', "event_type", "n").alias("value")
    n.select(line).unionAll(spark.createDataFrame([("# HELP up x",), ("up 1",), ("broken line",), ("",)], "value string")).write.text(path)
    return prometheus.scrape(spark, path).select("name", F.element_at("labels", "operation").alias("operation"), "value", "ts_ms")


# order and trees


@query(f"WITH {fx.ENTRIES} SELECT key, version, tombstone, node FROM entries WHERE key LIKE 'user:3%'")
def kv_raw_prefix(spark, d):
    return kv(spark, d).raw_scan("user:3").select("key", "version", "tombstone", "node")


@query(f"WITH {fx.ENTRIES} SELECT key, version, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS nth FROM entries")
def kv_merge_order(spark, d):
    return resolve.merge_order(fx.entries(spark, d)).select("key", "version", F.col("nth").cast("long").alias("nth"))


@query(f"{BASE} SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS total, row_number() OVER (ORDER BY key) < count(*) OVER () AS has_next FROM live")
def kv_cursor(spark, d):
    return kv(spark, d).positions()


@query(f"{BASE} SELECT key, version FROM live WHERE key GLOB 'user:?1*'")
def kv_glob(spark, d):
    return kv(spark, d).glob("user:?1*").select("key", "version")


@query(
    _LEAVES.replace("leaves AS", "keyed AS (SELECT key, (r * width - 1) // n AS leaf FROM shaped), leaves AS")
    + """, hurt AS (SELECT DISTINCT k.leaf FROM keyed k JOIN live v USING (key) WHERE v.version % 50 = 0) SELECT key FROM keyed WHERE leaf IN (SELECT leaf FROM hurt)"""
)
def merkle_tree_diff(spark, d):
    """Two trees over the same keys, some values of which differ."""
    own = kv(spark, d).scan().select("key", "value", "version")
    other = own.withColumn("value", F.when(F.col("version") % 50 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value")))
    return merkle.positional_diff(own, other)
