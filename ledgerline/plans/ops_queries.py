"""Queries of health, queues, rates, workloads and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import workload
from ..functions import text, vclock
from ..functions.hashing import scramble64
from ..model import byte_text
from ..operators import bloom, health, quorum, ring, telemetry
from ..sources import fixtures as fx
from .queries import _BEATS, FOUR, query

# rates and latencies


@query("""WITH l AS (SELECT event_type AS operation, list_sort(list(value) FILTER (value IS NOT NULL)) AS l, count(value) AS n, count(*) AS ops, count(*) FILTER (event_id % 10 = 0) AS errors, avg(value) AS a FROM events GROUP BY event_type)
SELECT operation, ops, errors, round(a, 9) AS avg_us, l[CAST(floor(n * 0.5::DOUBLE) AS BIGINT) + 1] AS p50_us, l[CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1] AS p95_us, l[CAST(floor(n * 0.99::DOUBLE) AS BIGINT) + 1] AS p99_us,
l[least(n, CAST(floor(n * 0.999::DOUBLE) AS BIGINT) + 1)] AS p999_us, l[n] AS max_us, l[1] AS min_us FROM l""")
def latency_report(spark, d):
    e = fx.timed_events(spark, d).select(F.col("event_type").alias("operation"), (F.col("event_id") % 10 != 0).alias("ok"), F.col("value").alias("latency_us"))
    return telemetry.latency_report(e, "operation").withColumn("avg_us", F.round("avg_us", 9))


_INCREASES = """s AS (SELECT event_type AS operation, user_id % 3 AS node, epoch_us(ts) AS ts_us, event_id % 1000 AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 3, ts ORDER BY event_id) = 1),
l AS (SELECT *, lag(value) OVER w AS v FROM s WINDOW w AS (PARTITION BY operation, node ORDER BY ts_us)),
i AS (SELECT *, CASE WHEN value < v THEN value ELSE value - v END AS delta FROM l WHERE v IS NOT NULL)"""


def _samples(spark, d):
    e = fx.timed_events(spark, d).select(F.col("event_type").alias("operation"), (F.col("user_id") % 3).alias("node"), "ts_us", "event_id")
    return e.groupBy("operation", "node", "ts_us").agg((F.min("event_id") % 1000).alias("value"))


@query(f"""WITH {_INCREASES}, t AS (SELECT operation, node, CAST(ceil(ts_us / 300000000.0::DOUBLE) AS BIGINT) AS step, sum(delta) AS delta FROM i GROUP BY ALL)
SELECT operation, node, (step + a) * 300000000 AS at_us, round(CAST(sum(delta) AS DOUBLE) * 1e6::DOUBLE / 3600000000, 9) AS rate FROM t, range(12) r(a) GROUP BY operation, node, step + a""")
def rate_window(spark, d):
    """rate(counter[1h]) at every five minutes."""
    return telemetry.windowed_rate(_samples(spark, d), ["operation", "node"], 3_600_000_000, 300_000_000).withColumn("rate", F.round("rate", 9))


@query(f"WITH {_INCREASES} SELECT ts_us // 600000000 AS period, operation, round(CAST(sum(delta) AS DOUBLE) * 1e6::DOUBLE / 600000000, 9) AS rate FROM i GROUP BY ALL")
def rate_by_label(spark, d):
    """sum by (operation) of the rates of all nodes."""
    return telemetry.summed_rate(_samples(spark, d), ["operation", "node"], ["operation"], 600_000_000).withColumn("rate", F.round("rate", 9))


# members


def _members(spark):
    i = F.col("id")
    state = F.when(i % 3 == 0, "alive").when(i % 3 == 1, "suspect").otherwise("dead")
    return spark.range(40).select(F.concat(F.lit("node-"), i).alias("node"), state.alias("state"), (i * 10).alias("last_seen"))


_MEMBERS = "members AS (SELECT 'node-' || i AS node, CASE i % 3 WHEN 0 THEN 'alive' WHEN 1 THEN 'suspect' ELSE 'dead' END AS state, i * 10 AS last_seen FROM range(40) r(i))"


@query(f"WITH {_MEMBERS}, {fx.ENTRIES} SELECT count(*) FILTER (state = 'alive') AS alive, count(*) FILTER (state = 'suspect') AS suspect, count(*) FILTER (state = 'dead') AS dead, count(*) AS total, (SELECT count(*) FROM entries WHERE tombstone) AS pending_hints FROM members")
def member_counts(spark, d):
    return health.member_counts(_members(spark), fx.entries(spark, d).where("tombstone"))


@query(f"WITH {_MEMBERS} SELECT event_id AS seq, 'node-' || (event_id % 50) AS node FROM events WHERE 'node-' || (event_id % 50) IN (SELECT node FROM members WHERE state = 'alive')")
def alive_rows(spark, d):
    rows = fx.timed_events(spark, d).select(F.col("event_id").alias("seq"), F.concat(F.lit("node-"), F.col("event_id") % 50).alias("node"))
    return health.alive_only(rows, _members(spark))


@query("SELECT 'node-' || (user_id % 20) AS node, arg_max(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY 1")
def member_states(spark, d):
    """Member states from a log of their changes."""
    e = fx.timed_events(spark, d).select(F.concat(F.lit("node-"), F.col("user_id") % 20).alias("node"), F.col("event_type").alias("state"), F.col("event_id").alias("seq"))
    return health.latest_state(e)


@query("""WITH m AS (SELECT 'node-' || i AS node, CASE i % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'leaving' WHEN 2 THEN 'down' ELSE 'healthy' END AS state, i AS last_seen FROM range(60) r(i)),
p AS (SELECT 'node-' || (user_id % 50) AS node, max(epoch_us(ts)) AS ts_us, arg_max(event_id % 2 = 0, struct_pack(t := epoch_us(ts), o := event_id % 2 = 0)) AS ok FROM events GROUP BY 1)
SELECT m.node, CASE WHEN p.node IS NULL OR state IN ('leaving', 'down') THEN state WHEN ok THEN 'healthy' ELSE 'unhealthy' END AS state, CASE WHEN p.node IS NULL OR state IN ('leaving', 'down') THEN last_seen ELSE ts_us END AS last_seen FROM m LEFT JOIN p ON m.node = p.node""")
def probe_states(spark, d):
    i = F.col("id")
    members = spark.range(60).select(F.concat(F.lit("node-"), i).alias("node"), F.when(i % 4 == 0, "unknown").when(i % 4 == 1, "leaving").when(i % 4 == 2, "down").otherwise("healthy").alias("state"), i.alias("last_seen"))
    probes = fx.timed_events(spark, d).select(F.concat(F.lit("node-"), F.col("user_id") % 50).alias("node"), "ts_us", (F.col("event_id") % 2 == 0).alias("ok"))
    return health.probe_states(members, probes)


@query("""WITH a AS (SELECT 'node-' || i AS node, 'a' || i AS addr, i * 7 % 30 AS heartbeat, 'suspect' AS state FROM range(30) r(i)), b AS (SELECT 'node-' || i AS node, 'b' || i AS addr, 15 AS heartbeat FROM range(20, 50) r(i))
SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL OR b.heartbeat > a.heartbeat THEN b.addr ELSE a.addr END AS addr, CAST(CASE WHEN a.node IS NULL OR b.heartbeat > a.heartbeat THEN b.heartbeat ELSE a.heartbeat END AS BIGINT) AS heartbeat,
CASE WHEN a.node IS NULL OR b.heartbeat > a.heartbeat THEN 'alive' ELSE a.state END AS state FROM a FULL JOIN b ON a.node = b.node""")
def gossip_merge(spark, d):
    i = F.col("id")
    mine = spark.range(30).select(F.concat(F.lit("node-"), i).alias("node"), F.concat(F.lit("a"), i).alias("addr"), (i * 7 % 30).alias("heartbeat"), F.lit("suspect").alias("state"))
    theirs = spark.range(20, 50).select(F.concat(F.lit("node-"), i).alias("node"), F.concat(F.lit("b"), i).alias("addr"), F.lit(15).cast("long").alias("heartbeat"))
    return health.merge_heartbeats(mine, theirs)


@query(f"WITH {_MEMBERS} SELECT node, state, last_seen FROM members WHERE state = 'alive' ORDER BY md5('42/' || node), node LIMIT 5")
def peer_sample(spark, d):
    return health.sample_peers(_members(spark), 5)


@query(f"""WITH {_MEMBERS}, u AS (SELECT node, row_number() OVER (ORDER BY md5('42/' || node), node) - 1 AS at, count(*) OVER () AS n FROM members WHERE state = 'alive')
SELECT a.node, b.node AS peer FROM u a, u b, range(1, 3) r(s) WHERE b.at = (a.at + s) % a.n""")
def gossip_round(spark, d):
    return health.gossip_round(_members(spark))


# queues and hints


@query(f"""WITH {fx.ENTRIES}, h AS (SELECT key || '/' || seq AS key, node AS target_node, seq AS created, CAST(seq // 3 % 12 AS INTEGER) AS attempts FROM entries WHERE tombstone)
SELECT target_node, key, created, CAST(attempts + CASE WHEN attempts < 10 AND created % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempts, CASE WHEN attempts >= 10 OR created % 3 = 0 THEN 'kept' ELSE 'delivered' END AS outcome FROM h""")
def hints_retry(spark, d):
    h = fx.entries(spark, d).where("tombstone").select(F.concat_ws("/", "key", "seq").alias("key"), F.col("node").alias("target_node"), F.col("seq").alias("created"), F.expr("cast(seq div 3 % 12 as int)").alias("attempts"))
    sent, kept = quorum.retry_hints(h, h.where("created % 3 = 0"))
    cols = ["target_node", "key", "created", "attempts"]
    return sent.select(*cols, F.lit("delivered").alias("outcome")).unionByName(kept.select(*cols, F.lit("kept").alias("outcome")))


@query("""SELECT 'peer-' || (user_id % 7) AS peer, count(*) FILTER (event_id % 4 < 2) AS enqueued, count(*) FILTER (event_id % 4 = 2) AS dequeued, count(*) FILTER (event_id % 12 = 3) AS dropped, count(*) FILTER (event_id % 4 = 3 AND event_id % 12 <> 3) AS errors,
count(*) FILTER (event_id % 4 < 2) - count(*) FILTER (event_id % 4 = 2) AS pending FROM events GROUP BY 1""")
def queue_stats(spark, d):
    i = F.col("event_id")
    event = F.when(i % 4 < 2, "enqueue").when(i % 4 == 2, "dequeue").when(i % 12 == 3, "drop").otherwise("error")
    return quorum.queue_stats(fx.timed_events(spark, d).select(F.concat(F.lit("peer-"), F.col("user_id") % 7).alias("peer"), event.alias("event")))


@query("SELECT 'peer-' || (user_id % 3) AS peer, event_id AS seq, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) <= 250 AS queued FROM events")
def queue_capped(spark, d):
    rows = fx.timed_events(spark, d).select(F.concat(F.lit("peer-"), F.col("user_id") % 3).alias("peer"), F.col("event_id").alias("seq"))
    return quorum.bounded_queue(rows, 250)


@query(f"""WITH RECURSIVE {_BEATS}, e AS (SELECT node, seq, ts_us, seq % 4 = 0 AS ok, row_number() OVER (PARTITION BY node ORDER BY ts_us, seq) AS r FROM beats), s AS (
  SELECT node, 0::BIGINT AS r, -1::BIGINT AS seq, 'closed' AS st, 0::BIGINT AS f, 0::BIGINT AS k, 0::BIGINT AS last, true AS allowed FROM (SELECT DISTINCT node FROM e)
  UNION ALL
  SELECT node, r, seq,
    CASE WHEN NOT go THEN 'open' WHEN half THEN CASE WHEN NOT ok THEN 'open' WHEN k2 + 1 >= 3 THEN 'closed' ELSE 'half_open' END WHEN ok OR f + 1 < 2 THEN 'closed' ELSE 'open' END,
    CASE WHEN NOT go THEN CASE WHEN st = 'half_open' THEN 0 ELSE f END WHEN half THEN CASE WHEN ok AND k2 + 1 < 3 THEN f ELSE 0 END WHEN ok THEN 0 ELSE f + 1 END,
    CASE WHEN NOT go THEN k WHEN half THEN CASE WHEN ok AND k2 + 1 < 3 THEN k2 + 1 ELSE 0 END ELSE k END,
    CASE WHEN go AND NOT ok THEN ts_us ELSE last END, go
  FROM (SELECT s.*, e.seq AS seq2, e.ok, e.ts_us, e.r AS r2, (s.st = 'closed') OR (s.st = 'open' AND e.ts_us - s.last > 600000000) OR (s.st = 'half_open' AND e.ts_us - s.last <= 600000000) AS go, s.st <> 'closed' AS half, CASE WHEN s.st = 'open' THEN 0 ELSE s.k END AS k2
    FROM s JOIN e ON e.node = s.node AND e.r = s.r + 1) x(node, r1, seq1, st, f, k, last, allowed, seq, ok, ts_us, r, go, half, k2)
) SELECT node, seq, st AS state, allowed FROM s WHERE r > 0""")
def rpc_breaker(spark, d):
    e = fx.heartbeats(spark, d).withColumn("ok", F.col("seq") % 4 == 0)
    return health.rpc_breaker_states(e, 2, 600_000_000, 3)


# placement and configuration


@query(f"WITH {fx.CRC}, {fx.ring_sql(FOUR, 'a')}, o AS (SELECT h, node, row_number() OVER (ORDER BY h) - 1 AS i, count(*) OVER () AS n FROM a_at) SELECT h AS position, node FROM o WHERE i % CAST(ceil(n / 200.0) AS BIGINT) = 0")
def ring_sampled(spark, d):
    return spark.createDataFrame(ring.Ring(FOUR).sampled(200), "position long, node string")


@query("SELECT n, w, r, w >= 1 AND r >= 1 AND w <= n AND r <= n AND w + r > n AS valid FROM range(1, 6) a(n), range(6) b(w), range(6) c(r)")
def quorum_configs(spark, d):
    def valid(*nwr):
        try:
            return bool(quorum.QuorumConfig(*nwr))
        except ValueError:
            return False

    return spark.createDataFrame([(n, w, r, valid(n, w, r)) for n in range(1, 6) for w in range(6) for r in range(6)], "n long, w long, r long, valid boolean")


# small functions


@query("""WITH p AS (SELECT n_nationkey AS id, '/api/v1/get/' || n_name AS path, CASE n_nationkey % 4 WHEN 0 THEN 'http://host' || n_nationkey || ':9000/x' WHEN 1 THEN 'host' || n_nationkey WHEN 2 THEN 'https://h' || n_nationkey || '/y:1' ELSE 'h' || n_nationkey || ':1' END AS address FROM nation)
SELECT id, path[13:] AS key, CASE id % 4 WHEN 0 THEN 'host' || id || ':7000' WHEN 1 THEN 'host' || id || ':7000' ELSE 'h' || id || ':7000' END AS rpc FROM p""")
def parsed_addresses(spark, d):
    i, name = F.col("n_nationkey"), F.col("n_name")
    address = F.when(i % 4 == 0, F.concat(F.lit("http://host"), i, F.lit(":9000/x"))).when(i % 4 == 1, F.concat(F.lit("host"), i)).when(i % 4 == 2, F.concat(F.lit("https://h"), i, F.lit("/y:1"))).otherwise(F.concat(F.lit("h"), i, F.lit(":1")))
    p = fx.table(spark, d, "nation").select(i.alias("id"), F.concat(F.lit("/api/v1/get/"), name).alias("path"), address.alias("address"))
    return p.select("id", text.key_from_path(F.col("path"), "/api/v1/get/").alias("key"), text.with_port(F.col("address"), 7000).alias("rpc"))


@query("""WITH n AS (SELECT CAST(o_orderkey AS BIGINT) * o_orderkey * 37 AS n FROM orders) SELECT DISTINCT n, CASE WHEN n >= 1099511627776 THEN printf('%.2f TB', n / 1099511627776.0::DOUBLE) WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS shown FROM n WHERE n < 1000::BIGINT << 40""")
def shown_bytes(spark, d):
    k = F.col("o_orderkey").cast("long")
    return fx.table(spark, d, "orders").select((k * k * 37).alias("n")).where(F.col("n") < 1000 << 40).distinct().select("n", F.replace(byte_text(F.col("n")), F.lit(","), F.lit("")).alias("shown"))


@query(f"WITH {fx.ENTRIES} SELECT seq, seq % 3 = 0 AS zero, seq % 3 <> 0 AS same FROM entries")
def vc_zero(spark, d):
    clock = F.when(F.col("seq") % 3 == 0, F.create_map(F.lit("n"), F.lit(0).cast("bigint"))).otherwise(F.create_map(F.lit("n"), F.col("seq")))
    own = fx.entries(spark, d).select("seq", clock.alias("c"))
    copy = vclock.merge(F.col("c"), vclock.empty())
    return own.select("seq", vclock.is_zero(F.col("c")).alias("zero"), (~vclock.is_zero(copy)).alias("same"))


@query("SELECT n, round(sum(pow(i, -0.99::DOUBLE)), 6) AS zeta FROM (VALUES (10), (1000), (20000)) v(n), range(1, 20001) r(i) WHERE i <= n GROUP BY n")
def zipf_constants(spark, d):
    return spark.createDataFrame([(n, round(workload.zeta(spark, n), 6)) for n in (10, 1000, 20000)], "n int, zeta double")


@query("""WITH b AS (SELECT id, list_transform(range(8), lambda i: (id >> (8 * i)) & 255) AS bytes FROM (SELECT event_id * 7919 AS id FROM events))
SELECT id, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(bytes, lambda x: x::UHUGEINT)), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) & 18446744073709551615::UHUGEINT) & 9223372036854775807::UHUGEINT AS BIGINT) AS h FROM b""")
def scrambled(spark, d):
    return fx.timed_events(spark, d).select((F.col("event_id") * 7919).alias("id")).withColumn("h", scramble64(F.col("id")))


_DRAW = "CAST(('0x' || md5('42/{p}/' || i)[1:13])::UBIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE"


def _mix_sql(read, update, insert, scan, rmw) -> str:
    bounds, cases = 0, ""
    for name, p in (("rmw", rmw), ("scan", scan), ("insert", insert), ("update", update), ("read", read)):
        cases += f" WHEN u >= {bounds} AND u < {bounds + p} THEN '{name}'"
        bounds += p
    return f"SELECT CASE{cases} END AS op FROM (SELECT {_DRAW.format(p='op')} * 100 AS u FROM range(20000) t(i))"


@query(" UNION ALL ".join(f"SELECT '{m}' AS mix, op, count(*) AS n FROM ({_mix_sql(*shares)}) GROUP BY op" for m, shares in {"A": (50, 50, 0, 0, 0), "B": (95, 5, 0, 0, 0), "C": (100, 0, 0, 0, 0), "D": (95, 0, 5, 0, 0), "E": (0, 0, 5, 95, 0), "F": (50, 0, 0, 0, 50)}.items()))
def ycsb_mixes(spark, d):
    """How often each operation comes in 20,000 of every mix."""
    out = None
    for name in "ABCDEF":
        own = workload.operations(spark, workload.PROFILES[name], 1000, 20_000).groupBy("op").agg(F.count("*").alias("n")).select(F.lit(name).alias("mix"), "op", "n")
        out = own if out is None else out.unionAll(own)
    return out


@query(f"""WITH d AS (SELECT i, {_DRAW.format(p="key")} AS u FROM range(20000) t(i)), z AS (SELECT sum(pow(k, -0.99::DOUBLE)) AS zn FROM range(1, 1001) r(k))
SELECT 'uniform' AS kind, CAST(floor(u * 1000) AS BIGINT) // 10 AS bucket, count(*) AS n FROM d GROUP BY ALL
UNION ALL SELECT 'latest', greatest(0, 999 - CAST(floor(-ln(1 - u) * 1000 * 0.01::DOUBLE) AS BIGINT)) // 10, count(*) FROM d GROUP BY ALL
UNION ALL SELECT 'log_uniform', least(999, CAST(floor(pow(1000.0::DOUBLE, u)) AS BIGINT) - 1) // 10, count(*) FROM d GROUP BY ALL
UNION ALL SELECT 'power_law', least(999, CAST(floor(pow((pow(1000.0::DOUBLE, 1 - 1.01::DOUBLE) - 1) * u + 1, 1 / (1 - 1.01::DOUBLE))) AS BIGINT) - 1) // 10, count(*) FROM d GROUP BY ALL
UNION ALL SELECT 'zipfian', CASE WHEN u * zn < 1 THEN 0 WHEN u * zn < 1 + pow(0.5::DOUBLE, 0.99::DOUBLE) THEN 1 ELSE least(999, CAST(floor(1000.0::DOUBLE * pow((1 - pow(2.0::DOUBLE / 1000, 1 - 0.99::DOUBLE)) / (1 - (1 + pow(0.5::DOUBLE, 0.99::DOUBLE)) / zn) * (u - 1) + 1, 1 / (1 - 0.99::DOUBLE))) AS BIGINT)) END // 10, count(*) FROM d, z GROUP BY ALL""")
def key_distributions(spark, d):
    """Keys drawn by each distribution, counted in tenths of a hundred."""
    n, zeta = 1000, workload.zeta(spark, 1000)
    u = workload.uniform(42, "key", F.col("id"))
    kinds = {"uniform": F.floor(u * n), "latest": workload.latest(u, n), "log_uniform": workload.log_uniform(u, n), "power_law": workload.power_law(u, n), "zipfian": workload.zipfian(u, n, zeta)}
    rows = spark.range(20_000).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("long").alias("record")) for k, v in kinds.items()])).alias("r"))
    return rows.groupBy("r.kind", F.expr("r.record div 10").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT i, {_DRAW.format(p="op")} * 100 AS o, CAST(floor(({_DRAW.format(p="key")}) * 500) AS BIGINT) AS record FROM range(3000) t(i)) SELECT 'update' AS op, count(*) AS n, count(*) AS found FROM d""")
def workload_run(spark, d):
    """A write-only mix over 500 loaded records: every key is found."""
    log = workload.operations(spark, workload.PROFILES["W"], 500, 3000)
    return workload.run(workload.preload(spark, 500), log)


@query("SELECT 0::BIGINT AS false_negatives, true AS few_false_positives")
def bloom_rates(spark, d):
    """No key that is in the filter is missed, and few others are taken for one."""
    keys = fx.entries(spark, d).select("key").distinct()
    m, k = bloom.sizing(keys.count())
    probe = keys.unionAll(spark.range(2000).select(F.concat(F.lit("absent:"), "id").alias("key")))
    got = bloom.might_contain(probe, bloom.build(keys, m, k), m, k)
    known = F.col("key").startswith("user:")
    return got.agg(F.count_if(known & ~F.col("maybe")).alias("false_negatives"), (F.count_if(~known & F.col("maybe")) < 0.05 * 2000).alias("few_false_positives"))
