"""The query suite: every query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import percentiles as pct
from ..functions import vclock
from ..model import violation
from ..operators import health, merkle, mutate, quorum, resolve, ring, telemetry, ttl
from ..operators.table import KVTable
from ..sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BASE = f"WITH {fx.ENTRIES}, {fx.WINNERS}"
FOUR, FIVE = [f"node-{i}" for i in range(1, 5)], [f"node-{i}" for i in range(1, 6)]
REPLICAS = f"""{fx.CRC}, {fx.ring_sql(fx.NODES, "r3")}, keys AS (
  SELECT DISTINCT key FROM entries
), hashed AS (
  SELECT key, {fx.crc_of("key")} AS kh FROM keys, crc_table
), clockwise AS (
  SELECT key, node, min(CASE WHEN h >= kh THEN h - kh ELSE h - kh + 4294967296 END) AS gap FROM hashed, r3_at GROUP BY key, node
), prefs AS (
  SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY gap) - 1 AS replica_index FROM clockwise
), replica_rows AS (
  SELECT e.key, e.value, e.version, e.ts_ns, e.tombstone, e.seq, p.node AS replica, p.replica_index
  FROM entries e JOIN prefs p USING (key) WHERE e.seq % 7 <> p.replica_index AND e.seq % 11 <> p.replica_index
), answers AS (
  SELECT * FROM replica_rows QUALIFY row_number() OVER (PARTITION BY key, replica ORDER BY version DESC) = 1
)"""


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def kv(spark, d) -> KVTable:
    return KVTable(fx.entries(spark, d))


# reads


@query(f"{BASE} SELECT key, value, version, ts_ns, node FROM live")
def kv_scan_all(spark, d):
    return kv(spark, d).scan().select("key", "value", "version", "ts_ns", "node")


@query(f"{BASE} SELECT key, value, version FROM live WHERE key LIKE 'user:1%'")
def kv_scan_prefix(spark, d):
    return kv(spark, d).scan("user:1").select("key", "value", "version")


@query(f"{BASE} SELECT key, value, version, ts_ns FROM live WHERE key = 'user:7'")
def kv_get(spark, d):
    return kv(spark, d).get("user:7").select("key", "value", "version", "ts_ns")


@query(f"{BASE} SELECT i AS pos, 'user:' || (i * 7) AS key, version IS NOT NULL AS found, version, value FROM range(40) r(i) LEFT JOIN live ON live.key = 'user:' || (i * 7)")
def kv_multiget_found(spark, d):
    return kv(spark, d).multi_get([f"user:{i * 7}" for i in range(40)]).select("pos", "key", "found", "version", "value")


@query(f"{BASE} SELECT key FROM live")
def kv_keys(spark, d):
    return kv(spark, d).keys()


@query(f"{BASE} SELECT key, version FROM live WHERE key >= 'user:12' ORDER BY key LIMIT 1")
def kv_seek(spark, d):
    return kv(spark, d).seek("user:12").select("key", "version")


@query(f"{BASE} SELECT 'first' AS which, min(key) AS key FROM live UNION ALL SELECT 'last', max(key) FROM live")
def kv_first_last(spark, d):
    t = kv(spark, d)
    return t.first().select(F.lit("first").alias("which"), "key").unionAll(t.last().select(F.lit("last").alias("which"), "key"))


@query(f"{BASE} SELECT key, version FROM live WHERE key > 'user:11' ORDER BY key LIMIT 10")
def kv_page_after(spark, d):
    return kv(spark, d).scan(start_after="user:11", limit=10).select("key", "version")


@query(f"WITH {fx.ENTRIES} SELECT key, version, tombstone FROM entries WHERE version > 500")
def kv_changes_since(spark, d):
    return kv(spark, d).changes_since(500).select("key", "version", "tombstone")


@query(f"""{BASE} SELECT (SELECT count(*) FROM entries) AS entries, (SELECT max(version) FROM entries) AS max_version, count(*) FILTER (NOT tombstone) AS live_keys,
 count(*) FILTER (tombstone) AS tombstones, CAST(sum(strlen(key) + strlen(coalesce(value, ''))) FILTER (NOT tombstone) AS BIGINT) AS live_bytes FROM winners""")
def kv_stats(spark, d):
    return kv(spark, d).stats()


@query(f"{BASE} SELECT key, version FROM winners WHERE tombstone")
def kv_tombstones(spark, d):
    return kv(spark, d).tombstones().select("key", "version")


@query(f"{BASE} SELECT key, version, tombstone FROM winners WHERE NOT (tombstone AND {fx.NOW_NS} - ts_ns > {fx.DAY_NS})")
def kv_compact_gc(spark, d):
    return resolve.collect_garbage(fx.entries(spark, d), fx.NOW_NS).select("key", "version", "tombstone")


@query(f"WITH {fx.ENTRIES} SELECT key, count(*) AS n_versions, count(*) FILTER (tombstone) AS n_tombstones, min(version) AS min_version, max(version) AS max_version FROM entries GROUP BY key")
def kv_versions_per_key(spark, d):
    return kv(spark, d).versions_per_key()


@query(f"WITH {fx.ENTRIES} SELECT key, version, value FROM (SELECT * FROM entries WHERE version <= 700 QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1) WHERE NOT tombstone")
def kv_as_of_version(spark, d):
    return resolve.as_of(fx.entries(spark, d), 700).select("key", "version", "value")


@query("""SELECT 'order:' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS key, CAST(l_linenumber AS BIGINT) AS version, epoch_us(l_shipdate) AS ship_us, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC) = 1""")
def kv_batch_dedup(spark, d):
    rows = fx.bulk(spark, d)
    return mutate.coalesce_writes(rows.withColumn("seq", F.struct("version", "ship_us", "l_partkey"))).drop("seq")


@query(f"{BASE} SELECT key, (SELECT max(version) FROM entries) + 1 AS version, value || '|rmw' AS value FROM live")
def kv_rmw(spark, d):
    log = fx.entries(spark, d)
    out = mutate.read_modify_write(log, log.select("key"), lambda v: F.concat(v, F.lit("|rmw")), "node-1", fx.NOW_NS)
    return out.select("key", "version", "value")


@query(f"""{BASE} SELECT '{{"' || key || '":' || to_json(value) || '}}' AS line FROM live""")
def kv_export_json(spark, d):
    from ..sources.json_map import export_lines

    return export_lines(kv(spark, d).scan())


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'empty key' WHEN o_orderkey % 10 = 1 THEN 'key too long' ELSE 'value too large' END AS reason
FROM orders WHERE o_orderkey % 10 < 2 OR o_orderkey % 500 = 7""")
def kv_validate_rejects(spark, d):
    k = F.col("o_orderkey")
    key = F.when(k % 10 == 0, "").when(k % 10 == 1, F.repeat(F.lit("k"), 1025)).otherwise(F.concat(F.lit("order:"), k))
    value = F.when(k % 500 == 7, F.repeat(F.lit("v"), (1 << 20) + 1)).otherwise("v")
    bad = fx.table(spark, d, "orders").select("o_orderkey", violation(key, value).alias("reason"))
    return bad.where("reason is not null")


# vector clocks


@query(f"WITH {fx.ENTRIES}, {fx.CLOCKS} SELECT seq, clock_node AS node, CAST(counter + CASE WHEN clock_node = 'node-2' THEN 1 ELSE 0 END AS BIGINT) AS counter FROM counts WHERE counter > 0 OR clock_node = 'node-2'")
def vc_increment(spark, d):
    out = fx.clocked(spark, d).select("seq", vclock.increment(F.col("vclock"), "node-2").alias("c"))
    return out.select("seq", F.explode("c").alias("node", "counter"))


@query(f"""WITH {fx.ENTRIES}, {fx.CLOCKS}, own AS (SELECT * FROM counts WHERE clock_node = node),
pairs AS (SELECT key, seq, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS before FROM entries)
SELECT p.seq, o.clock_node AS node, CAST(max(o.counter) AS BIGINT) AS counter FROM pairs p JOIN own o ON o.seq = p.seq OR o.seq = p.before GROUP BY p.seq, o.clock_node""")
def vc_merge(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("seq")
    own = fx.clocked(spark, d, local=True).withColumn("before", F.lag("vclock").over(w))
    return own.select("seq", F.explode(vclock.merge(F.col("vclock"), F.col("before"))).alias("node", "counter"))


@query(f"""WITH {fx.ENTRIES} SELECT seq, CASE WHEN lag(node) OVER w IS NULL OR lag(node) OVER w = node THEN 'AFTER' ELSE 'CONCURRENT' END AS relation FROM entries WINDOW w AS (PARTITION BY key ORDER BY seq)""")
def vc_compare(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("seq")
    own = fx.clocked(spark, d, local=True).withColumn("before", F.lag("vclock").over(w))
    return own.select("seq", vclock.compare(F.col("vclock"), F.col("before")).alias("relation"))


@query(f"WITH {fx.ENTRIES} SELECT key, node, max(version) AS version FROM entries GROUP BY key, node")
def vc_siblings(spark, d):
    return resolve.siblings(fx.clocked(spark, d, local=True)).select("key", "node", "version")


@query(f"WITH {fx.ENTRIES}, back AS (SELECT *, 1000000000 - version AS behind FROM entries) SELECT key, node, behind AS version FROM back QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def vc_causal_winner(spark, d):
    """Clocks say which entry is the last, versions that run backwards the first."""
    back = fx.clocked(spark, d).withColumn("version", 1_000_000_000 - F.col("version"))
    return resolve.winners(back, "causal").select("key", "node", "version")


# placement


def _customers(spark, d):
    return fx.table(spark, d, "customer").select(F.col("c_name").alias("key")).distinct()


def _owner_sql(nodes: list[str], name: str) -> str:
    return f"""{fx.ring_sql(nodes, name)}, {name}_own AS (
  SELECT k.key, coalesce(a.node, (SELECT arg_min(node, h) FROM {name}_at)) AS node
  FROM (SELECT key, {fx.crc_of("key")} AS kh FROM (SELECT DISTINCT c_name AS key FROM customer), crc_table) k ASOF LEFT JOIN {name}_at a ON a.h >= k.kh
)"""


@query(f"WITH {fx.CRC}, {_owner_sql(FOUR, 'a')} SELECT key, node AS owner FROM a_own")
def ring_owner(spark, d):
    return ring.owners(_customers(spark, d), ring.Ring(FOUR))


@query(f"WITH {fx.ENTRIES}, {REPLICAS} SELECT key, CAST(replica_index AS INTEGER) AS replica_index, node FROM prefs")
def ring_replicas(spark, d):
    return ring.replicas(fx.entries(spark, d).select("key").distinct(), ring.Ring(fx.NODES), 3)


@query(f"""WITH {fx.CRC}, {fx.ring_sql(FOUR, "a")}, wide AS (SELECT node, h - coalesce(lag(h) OVER (ORDER BY h), (SELECT max(h) FROM a_at) - 4294967296) AS w FROM a_at)
SELECT node, count(*) AS vnodes, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM a_at), 6) AS pct, round(sum(w)::DOUBLE * 100.0::DOUBLE / 4294967296.0::DOUBLE, 6) AS pct_width FROM wide GROUP BY node""")
def ring_distribution(spark, d):
    out = ring.distribution(spark, ring.Ring(FOUR))
    return out.select("node", "vnodes", F.round("pct", 6).alias("pct"), F.round("pct_width", 6).alias("pct_width"))


@query(f"WITH {fx.CRC}, {_owner_sql(FOUR, 'a')}, {_owner_sql(FIVE, 'b')} SELECT a.node AS from_node, b.node AS to_node, count(*) AS n_keys FROM a_own a JOIN b_own b USING (key) WHERE a.node <> b.node GROUP BY ALL")
def ring_movement_add(spark, d):
    return ring.movement(_customers(spark, d), ring.Ring(FOUR), ring.Ring(FOUR).with_node("node-5"))


@query(f"WITH {fx.CRC}, {_owner_sql(FIVE, 'a')}, {_owner_sql([n for n in FIVE if n != 'node-3'], 'b')} SELECT a.node AS from_node, b.node AS to_node, count(*) AS n_keys FROM a_own a JOIN b_own b USING (key) WHERE a.node <> b.node GROUP BY ALL")
def ring_movement_remove(spark, d):
    return ring.movement(_customers(spark, d), ring.Ring(FIVE), ring.Ring(FIVE).without_node("node-3"))


# quorum


@query(f"WITH {fx.ENTRIES}, {REPLICAS} SELECT e.seq, count(*) FILTER (e.seq % 7 <> p.replica_index) AS acks, count(*) FILTER (e.seq % 7 <> p.replica_index) >= 2 AS committed FROM entries e JOIN prefs p USING (key) GROUP BY e.seq")
def quorum_write_acks(spark, d):
    sent = ring.replicas(fx.entries(spark, d), ring.Ring(fx.NODES), 3).withColumn("ok", F.col("seq") % 7 != F.col("replica_index"))
    return quorum.write_acks(sent, quorum.QuorumConfig(), ["seq"])


def _answers(spark, d):
    return resolve.winners(fx.replica_rows(spark, d), "version", ("key", "replica"))


@query(f"""WITH {fx.ENTRIES}, {REPLICAS}, n AS (SELECT key, count(DISTINCT replica) AS n_answers FROM answers GROUP BY key)
SELECT key, version, tombstone, n_answers FROM (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1) JOIN n USING (key) WHERE n_answers >= 2""")
def quorum_read_latest(spark, d):
    return quorum.quorum_read(_answers(spark, d), quorum.QuorumConfig()).select("key", "version", "tombstone", "n_answers")


_FOUR_PREFS = f"""{fx.CRC}, {fx.ring_sql(FOUR, "a")}, hashed AS (
  SELECT key, {fx.crc_of("key")} AS kh FROM (SELECT DISTINCT key FROM entries), crc_table
), prefs AS (
  SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY min(CASE WHEN h >= kh THEN h - kh ELSE h - kh + 4294967296 END)) - 1 AS i FROM hashed, a_at GROUP BY key, node
)"""


@query(f"""WITH {fx.ENTRIES}, {_FOUR_PREFS}, up AS (
  SELECT key, node, CASE WHEN i < 3 THEN i ELSE 100 END AS o FROM prefs WHERE node <> 'node-2')
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY o, node) - 1 AS INTEGER) AS pos, node FROM up QUALIFY row_number() OVER (PARTITION BY key ORDER BY o, node) <= 3""")
def sloppy_fill(spark, d):
    keys = fx.entries(spark, d).select("key").distinct()
    out = quorum.effective_replicas(keys, ring.Ring(FOUR), [n for n in FOUR if n != "node-2"])
    return out.select("key", F.posexplode("replicas").alias("pos", "node"))


@query(f"WITH {fx.ENTRIES}, {REPLICAS}, w AS (SELECT key, max(version) AS want FROM answers GROUP BY key) SELECT key, replica, version AS have, want FROM answers JOIN w USING (key) WHERE version < want")
def read_repair_rows(spark, d):
    return quorum.repair_rows(_answers(spark, d))


@query(f"""WITH {fx.ENTRIES}, {REPLICAS}, v AS (SELECT key, version AS value, count(*) AS votes FROM answers GROUP BY ALL)
SELECT key, value, votes, CAST(sum(votes) OVER (PARTITION BY key) - votes AS BIGINT) AS repairs FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY votes DESC, value) = 1""")
def majority_value(spark, d):
    return quorum.majority(_answers(spark, d), "version")


@query(f"""WITH {fx.ENTRIES}, {_FOUR_PREFS} SELECT a.key, a.node AS target, b.node AS fallback FROM prefs a JOIN prefs b USING (key) WHERE a.node = 'node-2' AND a.i < 3 AND b.i >= 3""")
def hint_fallback_pairs(spark, d):
    keys = fx.entries(spark, d).select("key").distinct()
    return quorum.hint_pairs(keys, ring.Ring(FOUR), [n for n in FOUR if n != "node-2"])


@query(f"""WITH {fx.ENTRIES}, {REPLICAS}, x AS (SELECT key, version FROM answers WHERE replica = 'node-1'), y AS (SELECT key, version FROM answers WHERE replica = 'node-2')
SELECT coalesce(x.key, y.key) AS key, CASE WHEN y.version IS NULL OR x.version > y.version THEN 'push' WHEN x.version IS NULL OR y.version > x.version THEN 'pull' ELSE 'noop' END AS action FROM x FULL JOIN y ON x.key = y.key""")
def anti_entropy_actions(spark, d):
    a = _answers(spark, d)
    return quorum.anti_entropy(a.where("replica = 'node-1'"), a.where("replica = 'node-2'"))


_LEAVES = f"""{BASE}, ranked AS (
  SELECT key, strlen(key) || ':' || key || strlen(coalesce(value, '')) || ':' || coalesce(value, '') AS rec, row_number() OVER (ORDER BY key) AS r, count(*) OVER () AS n FROM live
), shaped AS (
  SELECT *, CAST(pow(2, greatest(0, ceil(log2(n / 4.0)))) AS BIGINT) AS width FROM ranked
), leaves AS (
  SELECT (r * width - 1) // n AS leaf, count(*) AS n_keys, min(key) AS first_key, max(key) AS last_key, sha256(string_agg(rec, '' ORDER BY key)) AS hash FROM shaped GROUP BY 1
)"""


@query(f"{_LEAVES} SELECT * FROM leaves")
def merkle_leaf_hashes(spark, d):
    return merkle.leaves(kv(spark, d).scan())


@query(
    _LEAVES.replace("WITH", "WITH RECURSIVE", 1)
    + """, tree(l) AS (
  SELECT list(hash ORDER BY leaf) FROM leaves
  UNION ALL SELECT list_transform(range(1, len(l) // 2 + 1), lambda i: sha256(l[2 * i - 1] || l[2 * i])) FROM tree WHERE len(l) > 1
) SELECT l[1] AS hash, (SELECT count(*) FROM leaves) AS n_leaves FROM tree WHERE len(l) = 1"""
)
def merkle_root(spark, d):
    return merkle.root(merkle.leaves(kv(spark, d).scan()))


@query(f"""WITH {fx.ENTRIES}, {REPLICAS}, x AS (SELECT key, value FROM answers WHERE replica = 'node-1'), y AS (SELECT key, value FROM answers WHERE replica = 'node-2')
SELECT coalesce(x.key, y.key) AS key, CASE WHEN y.key IS NULL THEN 'a' WHEN x.key IS NULL THEN 'b' ELSE 'both' END AS side FROM x FULL JOIN y ON x.key = y.key
WHERE x.key IS NULL OR y.key IS NULL OR coalesce(x.value, '') <> coalesce(y.value, '')""")
def merkle_diff(spark, d):
    a = _answers(spark, d)
    return merkle.diff(a.where("replica = 'node-1'"), a.where("replica = 'node-2'"), 64)


# time to live

_TTL = f"{fx.ENTRIES}, timers AS (SELECT key, seq, ts_ns + seq % 30 * {fx.DAY_NS} AS expire_at_ns FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


@query(f"WITH {_TTL} SELECT key, seq, expire_at_ns FROM timers WHERE expire_at_ns < {fx.NOW_NS}")
def ttl_expired(spark, d):
    return ttl.expired(fx.ttl_rows(spark, d), fx.NOW_NS).select("key", "seq", "expire_at_ns")


@query(f"WITH {_TTL} SELECT 'user:' || i AS key, expire_at_ns, coalesce(expire_at_ns < {fx.NOW_NS}, true) AS is_expired FROM range(0, 300, 3) r(i) LEFT JOIN timers ON key = 'user:' || i")
def ttl_lookup(spark, d):
    wanted = spark.range(0, 300, 3).select(F.concat(F.lit("user:"), "id").alias("key"))
    return ttl.lookup(wanted, fx.ttl_rows(spark, d), fx.NOW_NS)


# telemetry


def _pct_sql(index: str) -> str:
    cols = ", ".join(f"round(l[CAST({index.format(p=p)} AS BIGINT) + 1], 9) AS p{str(p)[2:]}" for p in (0.5, 0.95, 0.99))
    return f"SELECT operation, CAST(n AS BIGINT) AS n, {cols} FROM (SELECT event_type AS operation, count(value) AS n, list_sort(list(value) FILTER (value IS NOT NULL)) AS l FROM events GROUP BY event_type)"


def _pct(spark, d, rule):
    out = pct.percentiles(fx.requests(spark, d), ["operation"], "latency_ms", {"p5": 0.5, "p95": 0.95, "p99": 0.99}, rule)
    return out.select("operation", "n", *[F.round(c, 9).alias(c) for c in ("p5", "p95", "p99")])


@query(_pct_sql("least(n - 1, floor(n * {p}::DOUBLE))"))
def pct_ycsb(spark, d):
    return _pct(spark, d, "ycsb")


@query(_pct_sql("floor((n - 1) * {p}::DOUBLE)"))
def pct_phase(spark, d):
    return _pct(spark, d, "phase")


@query(_pct_sql("greatest(0, least(n - 1, ceil(n * {p}::DOUBLE) - 1))"))
def pct_nearest_rank(spark, d):
    return _pct(spark, d, "nearest_rank")


@query("""WITH b AS (SELECT event_type AS operation, CAST(floor(value / 5.0::DOUBLE) AS BIGINT) AS bucket, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY operation ORDER BY bucket) AS upto, sum(c) OVER (PARTITION BY operation) AS n FROM b)
SELECT operation, CAST(max(n) AS BIGINT) AS n, min(bucket) FILTER (upto >= floor(n::DOUBLE * 0.95::DOUBLE)) AS bucket FROM r GROUP BY operation""")
def pct_histogram(spark, d):
    return pct.histogram_percentile(fx.requests(spark, d), ["operation"], "latency_ms", 5.0, 0.95)


@query("SELECT epoch_us(ts) // 1000000 AS period, event_type AS operation, count(*) AS n FROM events GROUP BY ALL")
def ops_per_second(spark, d):
    return telemetry.per_period(fx.requests(spark, d), 1_000_000, "operation")


def _as_sql_rounds(column: str, places: int) -> Column:
    """A double rounded as the SQL's round() does: multiplied, rounded to a whole
    number, divided. F.round rounds the decimal digits instead, and gives another
    last digit near a half and where the product is over 2^53."""
    scaled = F.col(column) * F.lit(10.0**places)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / F.lit(10.0**places)).otherwise(F.col(column))


@query("""WITH s AS (SELECT event_type AS operation, epoch_us(ts) AS ts_us, event_id % 1000 AS value FROM events),
l AS (SELECT *, lag(value) OVER w AS v, lag(ts_us) OVER w AS t FROM s WINDOW w AS (PARTITION BY operation ORDER BY ts_us))
SELECT operation, ts_us, round((CASE WHEN value < v THEN value ELSE value - v END) * 1e6::DOUBLE / (ts_us - t), 9) AS rate FROM l WHERE v IS NOT NULL""")
def counter_rate(spark, d):
    s = fx.requests(spark, d).withColumn("value", F.col("seq") % 1000)
    return telemetry.counter_rate(s, ["operation"], ties=["seq"]).withColumn("rate", _as_sql_rounds("rate", 9))


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)


@query(f"""WITH b AS (SELECT event_type AS operation, le, count(*) FILTER (value <= le) AS n FROM events, (VALUES {", ".join(f"({b}::DOUBLE)" for b in _BOUNDS)}, ('inf'::DOUBLE)) v(le) WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, coalesce(lag(le) OVER w, 0.0::DOUBLE) AS low, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY operation) * 0.95::DOUBLE AS rank FROM b WINDOW w AS (PARTITION BY operation ORDER BY le))
SELECT operation, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, 9) AS quantile FROM r WHERE n >= rank AND rank > 0 QUALIFY row_number() OVER (PARTITION BY operation ORDER BY le) = 1""")
def histogram_quantile(spark, d):
    b = telemetry.bucket_counts(fx.requests(spark, d), "latency_ms", _BOUNDS, "operation")
    return telemetry.histogram_quantile(b, 0.95, "operation").withColumn("quantile", F.round("quantile", 9))


@query("""SELECT epoch_us(ts) // 3600000000 AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 9) AS ratio,
round(1.0::DOUBLE - count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 9) AS availability FROM events GROUP BY ALL""")
def error_ratio(spark, d):
    r = fx.requests(spark, d).withColumn("hour", F.floor(F.col("ts_us") / 3_600_000_000))
    return telemetry.error_ratio(r, "hour").withColumns({"ratio": F.round("ratio", 9), "availability": F.round("availability", 9)})


@query("""WITH s AS (SELECT epoch_us(ts) // 300000000 AS slot, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY ALL)
SELECT slot, round(sum(e) OVER a / (sum(n) OVER a)::DOUBLE / 0.01::DOUBLE, 6) AS short_burn, round(sum(e) OVER b / (sum(n) OVER b)::DOUBLE / 0.01::DOUBLE, 6) AS long_burn FROM s
WINDOW a AS (ORDER BY slot RANGE BETWEEN 0 PRECEDING AND CURRENT ROW), b AS (ORDER BY slot RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def burn_rate(spark, d):
    out = telemetry.burn_rate(fx.requests(spark, d), 300_000_000, 1, 12, 0.01)
    return out.select("slot", F.round("short_burn", 6).alias("short_burn"), F.round("long_burn", 6).alias("long_burn"))


@query("""WITH e AS (SELECT event_type AS operation, epoch_us(ts) AS ts_us, event_type <> 'error' AND event_id % 9 <> 0 AS firing FROM events),
r AS (SELECT *, sum(CASE WHEN firing THEN 0 ELSE 1 END) OVER (PARTITION BY operation ORDER BY ts_us) AS run FROM e)
SELECT operation, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n FROM r WHERE firing GROUP BY operation, run HAVING max(ts_us) - min(ts_us) >= 300000000""")
def alert_holddown(spark, d):
    e = fx.requests(spark, d).withColumn("firing", (F.col("operation") != "error") & (F.col("seq") % 9 != 0))
    return telemetry.hold_down(e, 300_000_000, ["operation"])


# health

_BEATS = "beats AS (SELECT 'node-' || (user_id % 5) AS node, epoch_us(ts) AS ts_us, event_id AS seq, value AS latency_ms FROM events)"
_NOW_US = fx.NOW_NS // 1000


@query(f"""WITH {_BEATS}, g AS (SELECT node, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY node ORDER BY ts_us) AS gap FROM beats),
k AS (SELECT node, gap FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts_us DESC) <= 1000),
m AS (SELECT node, count(*) AS n, avg(gap::DOUBLE) AS mean FROM k GROUP BY node), l AS (SELECT node, max(ts_us) AS last FROM beats GROUP BY node)
SELECT node, coalesce(n, 0) AS n_intervals, round(mean, 3) AS mean_us, round(CASE WHEN coalesce(n, 0) < 10 THEN 0 ELSE ({_NOW_US} - last) / mean / ln(10) END, 6) AS phi, (CASE WHEN coalesce(n, 0) < 10 THEN 0 ELSE ({_NOW_US} - last) / mean / ln(10) END) >= 8 AS dead FROM l LEFT JOIN m USING (node)""")
def phi_suspicion(spark, d):
    out = health.phi_accrual(fx.heartbeats(spark, d), _NOW_US)
    return out.select("node", "n_intervals", F.round("mean_us", 3).alias("mean_us"), F.round("phi", 6).alias("phi"), "dead")


@query(f"""WITH {_BEATS}, l AS (SELECT *, max(ts_us) OVER (PARTITION BY node) AS hi FROM beats), r AS (SELECT node, hi, count(*) AS n, min(ts_us) AS lo FROM l WHERE ts_us >= hi - 86400000000 GROUP BY node, hi),
k AS (SELECT 'node-' || i AS node FROM range(7) t(i)), p AS (SELECT node, n, CASE WHEN n < 3 OR (hi - lo) * 1000 // (n - 1) <= 0 THEN 0 ELSE ({_NOW_US} - hi) * 1000.0::DOUBLE / ((hi - lo) * 1000 // (n - 1)) END AS ratio FROM r)
SELECT k.node, coalesce(n, 0) AS n, round(coalesce(ratio, 9.0::DOUBLE), 6) AS ratio, coalesce(ratio, 9.0::DOUBLE) < 8 AS available FROM k LEFT JOIN p ON k.node = p.node""")
def ratio_suspicion(spark, d):
    known = spark.range(7).select(F.concat(F.lit("node-"), "id").alias("node"))
    out = health.ratio_suspicion(fx.heartbeats(spark, d), _NOW_US, 86_400_000_000, known)
    return out.select("node", "n", F.round("ratio", 6).alias("ratio"), "available")


@query(f"""WITH {_BEATS}, l AS (SELECT node, latency_ms FROM beats WHERE latency_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY seq DESC) <= 100)
SELECT node, count(*) AS n_samples, CASE WHEN count(*) < 3 THEN 500 ELSE CAST(floor(greatest(50.0::DOUBLE, least(5000.0::DOUBLE, quantile_disc(latency_ms, 0.95) * 2))) AS BIGINT) END AS timeout_ms FROM l GROUP BY node""")
def adaptive_timeout(spark, d):
    return health.adaptive_timeout(fx.heartbeats(spark, d))


@query(f"""WITH {_BEATS}, x AS (SELECT node, (SELECT max(ts_us) FROM beats) + 1000000 - max(ts_us) AS silent_us FROM beats GROUP BY node)
SELECT node, silent_us, CASE WHEN silent_us > 60000000 THEN 'dead' WHEN silent_us > 30000000 THEN 'suspect' ELSE 'alive' END AS state FROM x""")
def member_ageing(spark, d):
    beats = fx.heartbeats(spark, d)
    return health.member_ageing(beats, beats.agg(F.max("ts_us")).first()[0] + 1_000_000)


@query(f"""WITH a AS (SELECT 'node-' || (event_id % 40) AS node, CASE event_id % 3 WHEN 0 THEN 'alive' WHEN 1 THEN 'suspect' ELSE 'dead' END AS state, epoch_us(ts) AS last_seen, event_id // 300 AS incarnation FROM events)
SELECT node, state, last_seen, incarnation FROM a QUALIFY row_number() OVER (PARTITION BY node ORDER BY incarnation DESC, last_seen DESC, CASE state WHEN 'alive' THEN 0 WHEN 'suspect' THEN 1 ELSE 2 END DESC) = 1""")
def membership_merge(spark, d):
    e = fx.timed_events(spark, d)
    k = F.col("event_id") % 3
    rows = e.select(F.concat(F.lit("node-"), F.col("event_id") % 40).alias("node"), F.when(k == 0, "alive").when(k == 1, "suspect").otherwise("dead").alias("state"), F.col("ts_us").alias("last_seen"), F.expr("event_id div 300").alias("incarnation"), "event_id")
    return health.merge_members(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))


@query(f"""WITH RECURSIVE {_BEATS}, e AS (
  SELECT node, seq, ts_us, seq % 4 = 0 AS ok, row_number() OVER (PARTITION BY node ORDER BY ts_us, seq) AS r FROM beats
), s AS (
  SELECT node, 0::BIGINT AS r, -1::BIGINT AS seq, 'closed' AS st, 0::BIGINT AS f, 0::BIGINT AS k, 0::BIGINT AS o FROM (SELECT DISTINCT node FROM e)
  UNION ALL
  SELECT node, r, seq,
    CASE WHEN now = 'open' THEN 'open' WHEN now = 'half_open' THEN CASE WHEN NOT ok THEN 'open' WHEN k2 + 1 >= 3 THEN 'closed' ELSE now END WHEN ok THEN now WHEN f + 1 >= 5 THEN 'open' ELSE now END,
    CASE WHEN now = 'open' THEN f WHEN now = 'half_open' THEN CASE WHEN NOT ok THEN f + 1 WHEN k2 + 1 >= 3 THEN 0 ELSE f END WHEN ok THEN 0 ELSE f + 1 END,
    CASE WHEN now = 'open' THEN k2 WHEN now = 'half_open' AND ok AND k2 + 1 < 3 THEN k2 + 1 ELSE 0 END,
    CASE WHEN (now = 'half_open' AND NOT ok) OR (now = 'closed' AND NOT ok AND f + 1 >= 5) THEN ts_us ELSE o END
  FROM (SELECT e.node, e.r, e.seq, e.ok, e.ts_us, s.f, s.o, CASE WHEN s.st = 'open' AND e.ts_us - s.o >= 600000000 THEN 'half_open' ELSE s.st END AS now,
    CASE WHEN s.st = 'open' AND e.ts_us - s.o >= 600000000 THEN 0 ELSE s.k END AS k2 FROM s JOIN e ON e.node = s.node AND e.r = s.r + 1)
) SELECT node, seq, st AS state FROM s WHERE r > 0""")
def breaker_states(spark, d):
    e = fx.heartbeats(spark, d).withColumn("ok", F.col("seq") % 4 == 0)
    return health.breaker_states(e, 5, 600_000_000, 3)


@query(f"""WITH {fx.ENTRIES}, {REPLICAS} SELECT node AS peer, count(*) AS n_entries, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM entries e JOIN prefs p USING (key) GROUP BY p.node""".replace("SELECT node AS peer", "SELECT p.node AS peer"))
def queue_by_peer(spark, d):
    return quorum.group_by_peer(fx.entries(spark, d), ring.Ring(fx.NODES))


@query(f"""{BASE}, {fx.CRC}, {fx.ring_sql(fx.NODES, "a")}, own AS (
  SELECT k.*, coalesce(a.node, (SELECT arg_min(node, h) FROM a_at)) AS owner FROM (SELECT key, value, {fx.crc_of("key")} AS kh FROM live, crc_table) k ASOF LEFT JOIN a_at a ON a.h >= k.kh)
SELECT owner, count(*) AS live_keys, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes FROM own GROUP BY owner""")
def live_by_owner(spark, d):
    """Resolve, place, and sum: live keys and bytes of every node."""
    state = ring.owners(resolve.live(fx.entries(spark, d)), ring.Ring(fx.NODES))
    size = (F.octet_length("key") + F.octet_length("value")).cast("long")
    return state.groupBy("owner").agg(F.count("*").alias("live_keys"), F.sum(size).alias("bytes"))


# more reads and summaries


@query(f"{BASE} SELECT key, lag(key) OVER (ORDER BY key) AS before, lead(key) OVER (ORDER BY key) AS after FROM live")
def kv_neighbours(spark, d):
    return kv(spark, d).neighbours()


@query(f"{BASE} SELECT key, version FROM live WHERE key < 'user:5' ORDER BY key DESC LIMIT 7")
def kv_page_reverse(spark, d):
    return kv(spark, d).scan(start_after="user:5", reverse=True, limit=7).select("key", "version")


@query(f"{BASE} SELECT count(*) FILTER (live.key IS NOT NULL) AS found, count(*) FILTER (live.key IS NULL) AS missing FROM range(40) r(i) LEFT JOIN live ON live.key = 'user:' || (i * 7)")
def kv_found_missing(spark, d):
    got = kv(spark, d).exists([f"user:{i * 7}" for i in range(40)])
    return got.agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing"))


@query(f"WITH {fx.ENTRIES} SELECT node, count(*) AS entries, CAST(sum(strlen(key) + strlen(coalesce(value, ''))) AS BIGINT) AS bytes FROM entries GROUP BY node")
def kv_bytes_by_node(spark, d):
    return kv(spark, d).bytes_by("node")


@query(f"WITH {fx.ENTRIES} SELECT key, value, version FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone")
def kv_scan_by_arrival(spark, d):
    return KVTable(fx.entries(spark, d), "arrival").scan().select("key", "value", "version")


@query(f"{BASE} SELECT key, CASE WHEN length(value) > 20 THEN value[1:17] || '...' ELSE value END AS shown FROM live")
def kv_display(spark, d):
    from ..model import clip_text

    return kv(spark, d).scan().select("key", clip_text(F.col("value"), 20).alias("shown"))


@query("""WITH s AS (SELECT epoch_us(ts) // 60000000 AS minute, count(*) AS n FROM events GROUP BY 1), l AS (SELECT list_sort(list(n)) AS l, count(*) AS c, avg(n::DOUBLE) AS a FROM s)
SELECT c AS periods, round(a, 9) AS avg_n, l[CAST(least(c - 1, floor(c * 0.5::DOUBLE)) AS BIGINT) + 1] AS p50, l[CAST(least(c - 1, floor(c * 0.99::DOUBLE)) AS BIGINT) + 1] AS p99 FROM l""")
def throughput_summary(spark, d):
    per = telemetry.per_period(fx.requests(spark, d), 60_000_000).withColumn("all", F.lit(1))
    p = pct.percentiles(per, ["all"], "n", {"p50": 0.5, "p99": 0.99}, "ycsb")
    mean = per.groupBy("all").agg(F.round(F.avg(F.col("n").cast("double")), 9).alias("avg_n"))
    return p.join(mean, "all").select(F.col("n").alias("periods"), "avg_n", "p50", "p99")


@query(f"""WITH {_BEATS}, l AS (SELECT node, latency_ms FROM beats WHERE latency_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY seq DESC) <= 100),
t AS (SELECT node, CASE WHEN count(*) < 3 THEN 500 ELSE CAST(floor(greatest(50.0::DOUBLE, least(5000.0::DOUBLE, quantile_disc(latency_ms, 0.95) * 2))) AS BIGINT) END AS timeout_ms FROM l GROUP BY node), {fx.ENTRIES}, {REPLICAS}
SELECT p.key, CAST(max(coalesce(t.timeout_ms, 500)) AS BIGINT) AS timeout_ms FROM prefs p LEFT JOIN t ON t.node = p.node GROUP BY p.key""")
def timeout_for_replicas(spark, d):
    spread = ring.replicas(fx.entries(spark, d).select("key").distinct(), ring.Ring(fx.NODES), 3)
    return health.timeout_for(spread, health.adaptive_timeout(fx.heartbeats(spark, d)), ["key"])


@query(f"WITH {_BEATS}, g AS (SELECT node, ts_us - lag(ts_us) OVER (PARTITION BY node ORDER BY ts_us) AS gap, ts_us FROM beats) SELECT node, ts_us, gap AS gap_us FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts_us DESC) <= 1000")
def heartbeat_intervals(spark, d):
    return health.latest_intervals(fx.heartbeats(spark, d)).select("node", "ts_us", "gap_us")


@query("""WITH t AS (SELECT event_id AS seq, event_id // 100 AS epoch, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS sequence FROM events)
SELECT seq, epoch, sequence, epoch = (SELECT max(epoch) FROM t WHERE sequence = 1) AS valid FROM t""")
def fencing_tokens(spark, d):
    e = fx.timed_events(spark, d).select(F.col("event_id").alias("seq"), F.expr("event_id div 100").alias("epoch"))
    now = e.agg(F.max("epoch")).first()[0]
    return health.next_tokens(e).select("seq", "epoch", "sequence", quorum.token_valid("epoch", now).alias("valid"))


@query(f"""SELECT operation, le, count(*) FILTER (value / 1000.0::DOUBLE <= le) AS n FROM (SELECT event_type AS operation, value FROM events WHERE value IS NOT NULL), (SELECT unnest([0.001::DOUBLE, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 'inf']) AS le) v GROUP BY ALL""")
def latency_buckets(spark, d):
    r = fx.requests(spark, d).withColumn("s", F.col("latency_ms") / 1000.0)
    return telemetry.bucket_counts(r, "s", telemetry.LATENCY_BOUNDS, "operation")


@query("SELECT event_type AS worker, count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS errors, round(avg(value), 9) AS avg_us, min(value) AS min_us, max(value) AS max_us FROM events GROUP BY 1")
def bench_summary(spark, d):
    e = fx.timed_events(spark, d).select(F.col("event_type").alias("worker"), (F.col("event_id") % 10 != 0).alias("ok"), F.col("value").alias("latency_us"))
    return telemetry.latency_summary(e, "worker").withColumn("avg_us", F.round("avg_us", 9))


@query("""WITH RECURSIVE e AS (SELECT 'user:' || user_id AS key, event_id AS seq, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (
  SELECT key, r, seq, ts_us AS since, 1::BIGINT AS left_over, true AS allowed FROM e WHERE r = 1
  UNION ALL
  SELECT key, r, seq, since + gained * 60000000000, CASE WHEN have > 0 THEN have - 1 ELSE 0 END, have > 0
  FROM (SELECT e.key, e.r, e.seq, s.since, (e.ts_us - s.since) // 60000000000 AS gained, least(2, s.left_over + (e.ts_us - s.since) // 60000000000) AS have FROM s JOIN e ON e.key = s.key AND e.r = s.r + 1)
) SELECT key, seq, allowed FROM s""")
def rate_limiter(spark, d):
    e = fx.timed_events(spark, d).select(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("event_id").alias("seq"), "ts_us")
    return health.token_bucket(e, 2, 60_000_000_000)


@query(f"""WITH {fx.ENTRIES}, h AS (SELECT key, node AS target_node, seq AS created, CAST(seq % 12 AS INTEGER) AS attempts FROM entries WHERE tombstone)
SELECT target_node, key, created, attempts FROM h WHERE attempts < 10 AND target_node IN ('node-1', 'node-3')""")
def hints_to_deliver(spark, d):
    h = fx.entries(spark, d).where("tombstone").select("key", F.col("node").alias("target_node"), F.col("seq").alias("created"), (F.col("seq") % 12).cast("int").alias("attempts"))
    return quorum.deliverable_hints(h, spark.createDataFrame([("node-1",), ("node-3",)], "node string"))


@query(f"""WITH {fx.ENTRIES} SELECT node AS target_node, key, seq AS created FROM entries WHERE tombstone QUALIFY row_number() OVER (PARTITION BY node ORDER BY seq DESC, key DESC) <= 20""")
def hints_capped(spark, d):
    h = fx.entries(spark, d).where("tombstone").select(F.col("node").alias("target_node"), "key", F.col("seq").alias("created"))
    return quorum.newest_hints(h, 20)


@query()
def bloom_probe(spark, d):
    """Membership of keys that are and aren't in the table."""
    from ..operators import bloom

    keys = fx.entries(spark, d).select("key").distinct()
    m, k = bloom.sizing(keys.count())
    probe = keys.unionAll(spark.range(2000).select(F.concat(F.lit("absent:"), "id").alias("key")))
    return bloom.might_contain(probe, bloom.build(keys, m, k), m, k)


@query()
def ycsb_oplog(spark, d):
    """A deterministic operation log of mix A over the customers' number of records."""
    from .. import workload

    n = fx.table(spark, d, "customer").count()
    return workload.operations(spark, workload.PROFILES["A"], n, 10 * n)
