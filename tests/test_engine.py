import random

import pytest
from pyspark.sql import functions as F

from ledgerline import model
from ledgerline.functions import vclock
from ledgerline.operators import health, merkle, mutate, quorum, resolve, ring, telemetry, ttl
from ledgerline.operators.table import KVTable, next_prefix

DAY = 24 * 3600 * 10**9
SCHEMA = "key string, value string, version long, ts_ns long, tombstone boolean, seq long, node string"


def log(spark, rows):
    """Rows of (key, value or None for a delete, version); seq is the position."""
    return spark.createDataFrame([(k, v or "", ver, ver * 10, v is None, i, "n") for i, (k, v, ver) in enumerate(rows)], SCHEMA)


def state(df):
    return {r.key: r.value for r in df.collect()}


# resolution


def test_overwrite_delete_and_prefix(spark):
    t = KVTable(log(spark, [("user:1", "Alice", 1), ("user:2", "Bob", 2), ("session:1", "xyz", 3), ("user:2", None, 4), ("user:1", "Al", 5)]))
    assert [r.key for r in t.scan("user:").collect()] == ["user:1"]
    assert t.fetch("user:1").value == "Al"
    with pytest.raises(model.KeyNotFound):
        t.fetch("user:2")
    assert [r.key for r in t.tombstones().collect()] == ["user:2"]
    assert [r.found for r in t.multi_get(["user:1", "none", "user:2", "user:1"]).orderBy("pos").collect()] == [True, False, False, True]


def test_rules_differ_on_late_arrivals(spark):
    rows = log(spark, [("k", "new", 2), ("k", "old", 1)])
    assert state(resolve.live(rows, "version")) == {"k": "new"}
    assert state(resolve.live(rows, "arrival")) == {"k": "old"}


def test_a_newer_delete_beats_stale_copies_and_stays_deleted(spark):
    rows = log(spark, [("k", "a", 1), ("k", None, 3), ("k", "b", 2)])
    assert state(resolve.live(rows)) == {}


def test_resolution_ignores_order_and_is_idempotent(spark):
    r = random.Random(1)
    rows = [(f"k{r.randrange(20)}", r.choice(["x", "y", None]), r.randrange(50)) for _ in range(300)]
    base = log(spark, rows)
    want = sorted(map(str, resolve.winners(base).collect()))
    assert sorted(map(str, resolve.winners(base.repartition(7)).collect())) == want
    assert sorted(map(str, resolve.winners(resolve.winners(base)).collect())) == want
    model_state = {}
    for i, (k, v, ver) in enumerate(rows):
        if (ver, i) >= model_state.get(k, (-1, -1, None))[:2]:
            model_state[k] = (ver, i, v)
    assert state(resolve.live(base)) == {k: v for k, (_, _, v) in model_state.items() if v is not None}


def test_scan_equals_gets(spark):
    t = KVTable(log(spark, [(f"k{i % 7}", None if i % 5 == 0 else f"v{i}", i) for i in range(50)]))
    scanned = state(t.scan())
    for i in range(8):
        assert state(t.get(f"k{i}")) == ({f"k{i}": scanned[f"k{i}"]} if f"k{i}" in scanned else {})


def test_garbage_collection_keeps_young_tombstones(spark):
    now = 100 * DAY
    rows = [("key1", "v", 1, now - 3 * DAY, False, 0, "n"), ("key1", "", 2, now - 2 * DAY, True, 1, "n"), ("key2", "", 2, now, True, 2, "n"), ("key3", "x", 1, now - 9 * DAY, False, 3, "n")]
    out = resolve.collect_garbage(spark.createDataFrame(rows, SCHEMA), now)
    assert sorted((r.key, r.tombstone) for r in out.collect()) == [("key2", True), ("key3", False)]


def test_siblings_are_the_maximal_clocks(spark):
    r = random.Random(2)
    clocks = [{n: r.randrange(1, 4) for n in r.sample("abc", r.randrange(0, 4))} for _ in range(60)]
    rows = [(f"k{i % 6}", "", i, i, False, i, "n", c) for i, c in enumerate(clocks)]
    df = spark.createDataFrame(rows, SCHEMA + ", vclock map<string,long>")

    def below(a, b):
        return all(b.get(n, 0) >= v for n, v in a.items()) and any(v > a.get(n, 0) for n, v in b.items())

    want = set()
    for i, c in enumerate(clocks):
        peers = [(j, d) for j, d in enumerate(clocks) if j % 6 == i % 6]
        if not any(below(c, d) for _, d in peers) and i == max(j for j, d in peers if d == c):
            want.add(i)
    assert {x.seq for x in resolve.siblings(df).collect()} == want


# clocks


@pytest.mark.parametrize("a, b, want", [({"x": 1}, {"x": 1, "y": 1}, "BEFORE"), ({"x": 1, "y": 1}, {"x": 1}, "AFTER"), ({"x": 1}, {"y": 1}, "CONCURRENT"), ({}, {}, "AFTER"), ({"x": 2}, {"x": 2}, "AFTER"), (None, {"x": 1}, "BEFORE")])
def test_compare(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a map<string,long>, b map<string,long>")
    row = df.select(vclock.compare(F.col("a"), F.col("b")), vclock.merge(F.col("a"), F.col("b")), vclock.increment(F.col("a"), "x"), vclock.is_zero(F.col("a"))).first()
    a = a or {}
    assert row[0] == want
    assert row[1] == {k: max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}}
    assert row[2] == a | {"x": a.get("x", 0) + 1}
    assert row[3] == (not a)


# reads


def test_seek_pages_and_bounds(spark):
    t = KVTable(log(spark, [(k, "v", i) for i, k in enumerate(["Z", "a", "b", "c", "é", "日"])]))
    assert t.seek("aa").first().key == "b"
    assert (t.first().first().key, t.last().first().key) == ("Z", "日")
    assert [[r.key for r in p] for p in t.pages(4)] == [["Z", "a", "b", "c"], ["é", "日"]]
    assert [r.key for r in t.scan(start_after="c", reverse=True, limit=2).collect()] == ["b", "a"]
    assert [r.key for r in t.cursor()] == ["Z", "a", "b", "c", "é", "日"]
    assert t.seek("龥").first() is None
    assert next_prefix("a\U0010ffff") == "b" and next_prefix("\U0010ffff") is None
    assert t.stats().first().asDict() == {"entries": 6, "max_version": 5, "live_keys": 6, "tombstones": 0, "live_bytes": 15}


def test_empty_table(spark):
    t = KVTable(log(spark, []))
    assert t.scan().collect() == [] and t.first().collect() == [] and t.stats().first().live_keys == 0
    assert merkle.root(merkle.leaves(t.scan())).collect() == []


def test_prefix_reaches_the_scan(spark, tmp_path):
    log(spark, [("user:1", "x", 1)]).write.parquet(str(tmp_path / "t"))
    df = KVTable(spark.read.parquet(str(tmp_path / "t"))).scan("user:")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,user:)" in plan and "LessThan(key,user;)" in plan


# writes


def test_batch_put_delete_and_rmw(spark):
    base = log(spark, [("a", "1", 5)])
    batch = spark.createDataFrame([(0, "a", "2"), (1, "b", "3"), (2, "a", "4"), (3, "", "x"), (4, "k" * 1025, "x"), (5, "k" * 1024, "x")], "pos long, key string, value string")
    rows, bad = mutate.batch_put(base, batch, "n1", 777)
    assert {(r.key, r.value, r.version) for r in rows.collect() if len(r.key) < 9} == {("b", "3", 7), ("a", "4", 8)}
    assert sorted(r.reason for r in bad.collect()) == ["empty key", "key too long"]
    both = base.unionByName(rows.select(*base.columns))
    gone, missing = mutate.delete(both, spark.createDataFrame([("a",), ("nope",)], "key string"), "n1", 778, strict=True)
    assert [r.key for r in missing.collect()] == ["nope"] and [r.key for r in gone.collect()] == ["a"]
    out = mutate.read_modify_write(both, spark.createDataFrame([("b",)], "key string"), lambda v: F.concat(v, F.lit("!")), "n2", 779)
    assert [(r.key, r.value, r.version) for r in out.collect()] == [("b", "3!", 12)]


# placement


def test_ring_balance_and_movement(spark):
    keys = spark.range(40000).select(F.concat(F.lit("key-"), "id").alias("key"))
    four = ring.Ring([f"node-{i}" for i in range(1, 5)])
    assert four.owner_of("user:1") == ring.owners(spark.createDataFrame([("user:1",)], "key string"), four).first().owner
    shares = {r.owner: r["count"] for r in ring.owners(keys, four).groupBy("owner").count().collect()}
    assert all(7000 < n < 13000 for n in shares.values()) and len(shares) == 4
    moved = ring.movement(keys, four, four.with_node("node-5")).collect()
    assert {r.to_node for r in moved} == {"node-5"} and 4000 < sum(r.n_keys for r in moved) < 12000
    five = four.with_node("node-5")
    gone = ring.movement(keys, five, five.without_node("node-3")).collect()
    assert {r.from_node for r in gone} == {"node-3"}
    plan = ring.owners(keys, four)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_replicas_are_distinct_and_clockwise(spark):
    r = ring.Ring(["a", "b", "c", "d"])
    got = ring.replicas(spark.createDataFrame([("k1",), ("k2",)], "key string"), r, 3).collect()
    for k in ("k1", "k2"):
        own = [x.node for x in sorted(got, key=lambda x: x.replica_index) if x.key == k]
        assert len(set(own)) == 3 and own[0] == r.owner_of(k)
    assert ring.replicas(spark.createDataFrame([("k1",)], "key string"), ring.Ring(["a"]), 3).count() == 1


def test_quorum_config():
    for bad in ((3, 4, 2), (3, 1, 1), (3, 0, 3)):
        with pytest.raises(ValueError):
            quorum.QuorumConfig(*bad)


def test_quorum_sees_the_last_committed_write(spark):
    rows = [("k", "old", 1, "r1"), ("k", "new", 2, "r2"), ("k", "old", 1, "r3"), ("x", "only", 1, "r1")]
    answers = spark.createDataFrame(rows, "key string, value string, version long, replica string")
    assert [(r.key, r.value, r.n_answers) for r in quorum.quorum_read(answers, quorum.QuorumConfig()).collect()] == [("k", "new", 3)]
    assert {(r.replica, r.want) for r in quorum.repair_rows(answers).collect()} == {("r1", 2), ("r3", 2)}
    assert {(r.key, r.value, r.repairs) for r in quorum.majority(answers).collect()} == {("k", "old", 1), ("x", "only", 0)}
    with pytest.raises(model.QuorumNotReached):
        quorum.require_quorum(answers, quorum.QuorumConfig())


def test_hints(spark):
    h = spark.createDataFrame([("n1", "a", 1, 0), ("n1", "b", 2, 10), ("n2", "c", 3, 0)], "target_node string, key string, created long, attempts int")
    up = spark.createDataFrame([("n1",)], "node string")
    assert [r.key for r in quorum.deliverable_hints(h, up).collect()] == ["a"]
    assert {r.key for r in quorum.newest_hints(h, 1).collect()} == {"b", "c"}


@pytest.mark.parametrize("n", [1, 4, 5, 9, 33])
def test_merkle_tree(spark, n):
    import hashlib

    rows = [(f"k{i:03}", f"v{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "key string, value string").repartition(3)
    leaves = merkle.leaves(df)
    got = sorted(leaves.collect(), key=lambda r: r.leaf)
    assert sum(r.n_keys for r in got) == n and max(r.n_keys for r in got) <= 4 and [r.leaf for r in got] == list(range(len(got)))
    hashes = [r.hash for r in got]
    assert hashes[0] == hashlib.sha256("".join(f"{len(k)}:{k}{len(v)}:{v}" for k, v in rows[: got[0].n_keys]).encode()).hexdigest()
    while len(hashes) > 1:
        hashes = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(hashes[::2], hashes[1::2])]
    assert merkle.root(leaves).first().hash == hashes[0]


def test_merkle_diff(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("ab", "c")], "key string, value string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("ab", "c")], "key string, value string")
    assert {(r.key, r.side) for r in merkle.diff(a, b, 16).collect()} == {("b", "both"), ("c", "a"), ("d", "b")}
    assert merkle.diff(a, a, 16).collect() == []


# health, time to live, telemetry


def test_phi_needs_ten_gaps_and_grows(spark):
    beats = spark.createDataFrame([("a", i * 1000) for i in range(20)] + [("b", i * 1000) for i in range(5)] + [("c", 0)], "node string, ts_us long")
    got = {r.node: r for r in health.phi_accrual(beats, 19_000 + 100_000).collect()}
    assert got["a"].dead and got["a"].phi > 40 and got["b"].phi == 0 and got["c"].n_intervals == 0


def test_timeouts(spark):
    rows = [("fast", i, 10.0) for i in range(50)] + [("slow", i, 9000.0) for i in range(50)] + [("mid", i, float(i)) for i in range(1, 301)] + [("new", 1, 1.0)]
    got = {r.node: r.timeout_ms for r in health.adaptive_timeout(spark.createDataFrame(rows, "node string, seq long, latency_ms double")).collect()}
    assert got == {"fast": 50, "slow": 5000, "mid": 590, "new": 500}


def test_breaker(spark):
    ev = [(i, False) for i in range(5)] + [(10, True), (40, True), (41, True), (42, True), (43, False)]
    df = spark.createDataFrame([("n", i, t * 1_000_000, ok) for i, (t, ok) in enumerate(ev)], "node string, seq long, ts_us long, ok boolean")
    got = [r.state for r in sorted(health.breaker_states(df).collect(), key=lambda r: r.seq)]
    assert got == ["closed"] * 4 + ["open", "open", "half_open", "half_open", "closed", "closed"]


def test_membership_merge_is_commutative(spark):
    kind = "node string, state string, last_seen long, incarnation long"
    a = spark.createDataFrame([("x", "dead", 5, 1), ("y", "alive", 1, 1)], kind)
    b = spark.createDataFrame([("x", "alive", 9, 2), ("y", "suspect", 1, 1), ("z", "alive", 1, 1)], kind)
    got = {tuple(r) for r in health.merge_members(a, b).collect()}
    assert got == {("x", "alive", 9, 2), ("y", "suspect", 1, 1), ("z", "alive", 1, 1)} == {tuple(r) for r in health.merge_members(b, a).collect()}


def test_ttl(spark):
    t = spark.createDataFrame([("a", 1, 10), ("a", 2, 99), ("b", 3, 10)], "key string, seq long, expire_at_ns long")
    assert [r.key for r in ttl.expired(t, 11).collect()] == ["b"] and ttl.expired(t, 10).collect() == []
    got = {r.key: r.is_expired for r in ttl.lookup(spark.createDataFrame([("a",), ("b",), ("zz",)], "key string"), t, 50).collect()}
    assert got == {"a": False, "b": True, "zz": True}


def test_counter_reset_and_empty_histogram(spark):
    s = spark.createDataFrame([("c", 0, 10), ("c", 1_000_000, 15), ("c", 2_000_000, 3)], "k string, ts_us long, value long")
    assert [r.rate for r in telemetry.counter_rate(s, ["k"]).orderBy("ts_us").collect()] == [5.0, 3.0]
    e = spark.createDataFrame([("a", 20.0)], "k string, v double")
    b = telemetry.bucket_counts(e, "v", (1.0, 5.0), "k")
    assert telemetry.histogram_quantile(b, 0.9, "k").first().quantile == 5.0
    assert telemetry.histogram_quantile(b.where("n > 5"), 0.9, "k").collect() == []


def test_counter_samples_of_one_time(spark):
    rows = [("c", t * 1_000_000, v, i) for i, (t, v) in enumerate([(0, 1), (0, 4), (0, 4), (0, 2), (1, 5), (9000, 7), (9000, 6), (9001, 9)])]
    s = spark.createDataFrame(rows, "k string, ts_us long, value long, seq long").repartition(3)
    got = telemetry.counter_rate(s, ["k"], ties=["seq"]).collect()
    inf = float("inf")
    assert sorted((r.ts_us // 1_000_000, repr(r.rate)) for r in got) == sorted((t, repr(x)) for t, x in [(0, inf), (0, float("nan")), (0, inf), (1, 3.0), (9000, 2 / 8999), (9000, inf), (9001, 3.0)])
    own = {repr(r.rate) for r in telemetry.counter_rate(s, ["k"]).where("ts_us = 9001000000").collect()}
    assert own == {"2.0"}  # by value where nothing else orders a tie, on both sides of a slice's end


def test_display(spark):
    r = spark.createDataFrame([("x" * 60, 2048)], "t string, n long").select(model.clip_text(F.col("t")), model.byte_text(F.col("n"))).first()
    assert len(r[0]) == 50 and r[0].endswith("...") and r[1] == "2.00 KB"


def test_glob_and_counts(spark):
    t = KVTable(log(spark, [(k, "v", i) for i, k in enumerate(["user:1", "user:12", "user:%", "uzer:1", "user:1x2"])]))
    keys = lambda p: [r.key for r in t.glob(p).collect()]
    assert keys("user:1*") == ["user:1", "user:12", "user:1x2"] and keys("user:?") == ["user:%", "user:1"]
    assert keys("u?er:1") == ["user:1", "uzer:1"] and keys("user:%") == ["user:%"] and keys("*2") == ["user:12", "user:1x2"]
    m = spark.createDataFrame([("a", "alive"), ("b", "dead"), ("c", "alive")], "node string, state string")
    assert health.member_counts(m).first().asDict() == {"alive": 2, "suspect": 0, "dead": 1, "total": 3}
    assert {r.node for r in health.sample_peers(m, 5).collect()} == {"a", "c"} and health.sample_peers(m, 1).count() == 1
    tok = health.next_tokens(spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "epoch long, seq long"))
    assert {tuple(r) for r in tok.collect()} == {(1, 5, 1), (1, 6, 2), (2, 7, 1)}
    assert len(ring.Ring(["a", "b", "c"]).sampled()) <= 200


def test_summed_rate(spark):
    s = spark.createDataFrame([(n, "get", t * 1_000_000, 10 * t) for n in "ab" for t in range(11)], "node string, op string, ts_us long, value long")
    got = telemetry.summed_rate(s, ["node", "op"], ["op"], 10_000_000).orderBy("period").collect()
    assert [(r.period, r.rate) for r in got] == [(0, 18.0), (1, 2.0)]


def test_settings(tmp_path):
    from ledgerline.config import Settings

    (tmp_path / "c.json").write_text('{"replicas": 5, "write_quorum": 3, "read_quorum": 3}')
    s = Settings.load(str(tmp_path / "c.json"), {"LEDGERLINE_VNODES": "10", "LEDGERLINE_NODE": "n9"})
    assert (s.replicas, s.vnodes, s.node) == (5, 10, "n9") and Settings(shuffle_partitions=7).spark_conf()
    for bad in ({"replicas": 1}, {"vnodes": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    (tmp_path / "d.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        Settings.load(str(tmp_path / "d.json"), {})
