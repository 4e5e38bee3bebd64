"""Operators against plain Python, on cases that the query suite doesn't reach."""

import io
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.__main__ import main
from ledgerline.functions import percentiles as pct
from ledgerline.functions.text import key_from_path, split_words, with_port
from ledgerline.model import MAX_BATCH, InvalidEntry
from ledgerline.operators import health, merkle, mutate, quorum, resolve, ring, telemetry
from ledgerline.plans.scratch import fresh, scratch_dir
from ledgerline.plans.store import Store


def spread(df, keys):
    """Rows of the largest and the median part of rows dealt by some columns."""
    n = sorted(r["count"] for r in df.groupBy(*keys).count().collect())
    return n[-1], n[len(n) // 2]


# one label that holds nearly everything


def hot(spark, n=4000):
    r = random.Random(1)
    rows = [("a" if i % 50 else "b", i * 1_000_000 + r.randrange(900_000), r.random() * 100, i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, ts_us long, v double, seq long").repartition(8)


def test_percentiles_of_a_hot_label(spark):
    rows, df = hot(spark)
    for rule, index in (("ycsb", lambda n, p: min(n - 1, int(n * p))), ("phase", lambda n, p: int((n - 1) * p)), ("nearest_rank", lambda n, p: max(0, min(n - 1, math.ceil(n * p) - 1)))):
        got = {r.k: (r.n, r.p1, r.p50, r.p99) for r in pct.percentiles(df, ["k"], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99}, rule).collect()}
        for k in "ab":
            s = sorted(x[2] for x in rows if x[0] == k)
            assert got[k] == (len(s), *(s[index(len(s), p)] for p in (0.01, 0.5, 0.99)))
    most, median = spread(pct_ranges(df), ["_part"])
    assert most < 2 * median


def pct_ranges(df):
    return df.select("k", "v").repartitionByRange(8, "k", "v").withColumn("_part", F.spark_partition_id())


def test_percentiles_of_nulls_and_empty_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None), ("y", 2.0)], "k string, v double")
    got = {r.k: (r.n, r.p) for r in pct.percentiles(df, ["k"], "v", {"p": 0.5}, "phase").collect()}
    assert got == {None: (2, 1.0), "y": (1, 2.0)}
    assert pct.percentiles(df.where("v > 9"), ["k"], "v", {"p": 0.5}, "ycsb").collect() == []
    assert pct.histogram_percentile(df, ["k"], "v", 1.0, 0.0).where("k is null").first().bucket == 1


def test_slices_of_a_hot_label(spark):
    rows, df = hot(spark)
    for slice_us in (10_000_000, 10**15):
        got = {(r.k, r.ts_us): r._before for r in telemetry.with_previous(df, ["k"], ["ts_us", "seq"], slice_us=slice_us).collect()}
        for k in "ab":
            own = sorted(x[1] for x in rows if x[0] == k)
            assert [got[k, t] and got[k, t].ts_us for t in own] == [None, *own[:-1]]
    most, median = spread(df.withColumn("s", F.floor(F.col("ts_us") / 100_000_000)), ["k", "s"])
    assert most <= 100 and median > 1


def test_hold_down_over_slices(spark):
    r = random.Random(2)
    rows, firing = [], False
    for i in range(3000):
        firing = firing if r.random() < 0.97 else not firing
        rows.append(("a" if i < 2500 else "b", i * 1_000_000, firing if i % 7 else (firing or None)))
    df = spark.createDataFrame(rows, "k string, ts_us long, firing boolean").repartition(5)
    want = []
    for k in "ab":
        run = []
        for _, t, f in [x for x in rows if x[0] == k] + [(k, None, False)]:
            if f:
                run.append(t)
            elif run:
                if run[-1] - run[0] >= 20_000_000:
                    want.append((k, run[0], run[-1], len(run)))
                run = []
    for slice_us in (3_000_000, 37_000_000, 10**15):
        got = sorted(tuple(x) for x in telemetry.hold_down(df, 20_000_000, ["k"], slice_us).select("k", "start_us", "end_us", "n").collect())
        assert got == sorted(want) and len(want) > 10


def test_newest_rows_of_a_hot_key(spark):
    rows, df = hot(spark)
    got = sorted(r.ts_us for r in health.newest(df, "k", "ts_us", 30).where("k = 'a'").collect())
    assert got == sorted(x[1] for x in rows if x[0] == "a")[-30:]
    beats = df.select(F.col("k").alias("node"), "ts_us")
    gaps = [r.gap_us for r in health.latest_intervals(beats, 10).where("node = 'a'").orderBy("ts_us").collect()]
    t = sorted(x[1] for x in rows if x[0] == "a")[-11:]
    assert gaps == [b - a for a, b in zip(t, t[1:])]


def test_windowed_rate(spark):
    s = spark.createDataFrame([("c", t * 1_000_000, 5 * t if t < 50 else 3 * (t - 50)) for t in range(0, 100, 2)], "k string, ts_us long, value long")
    got = {r.at_us // 1_000_000: r.rate for r in telemetry.windowed_rate(s, ["k"], 20_000_000, 10_000_000).collect()}
    grown = {t: (10 if t < 50 else 0 if t == 50 else 6) for t in range(2, 100, 2)}
    assert got[40] == sum(v for t, v in grown.items() if 20 < t <= 40) / 20
    assert got[60] == sum(v for t, v in grown.items() if 40 < t <= 60) / 20
    assert 10 in got and 110 in got and 120 not in got


# trees


@pytest.mark.parametrize("m,n", [(1, 1), (9, 9), (3, 33), (33, 3), (0, 5), (5, 0), (40, 70)])
def test_positional_diff(spark, m, n):
    import hashlib

    def tree(rows):
        d = merkle.depth_for(len(rows))
        leaf = [((r + 1) * (1 << d) - 1) // max(1, len(rows)) for r in range(len(rows))]
        groups = [[rows[i] for i in range(len(rows)) if leaf[i] == j] for j in range(1 << d)] if rows else []
        level = [hashlib.sha256("".join(f"{len(k)}:{k}{len(v)}:{v}" for k, v in g).encode()).hexdigest() for g in groups]
        out = [level]
        while len(out[-1]) > 1:
            out.append([hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(out[-1][::2], out[-1][1::2])])
        return out[::-1], groups

    a = [(f"k{i:03}", f"v{i}") for i in range(m)]
    b = [(f"k{i:03}", f"v{i}" if i % 5 else "x") for i in range(n)]
    (ta, ga), (tb, gb) = tree(a), tree(b)
    if not a or not b:
        want = {k for k, _ in a + b}
    else:
        d = min(len(ta), len(tb)) - 1
        want = set()
        for j in range(1 << d):
            if ta[d][j] != tb[d][j]:
                want |= {k for k, _ in ga[j]} if len(ta) - 1 == d else set()
                want |= {k for k, _ in gb[j]} if len(tb) - 1 == d else set()
    frame = lambda rows: spark.createDataFrame(rows, "key string, value string").repartition(3)
    got = [r.key for r in merkle.positional_diff(frame(a), frame(b)).collect()]
    assert sorted(got) == sorted(want)


def test_levels_end_in_the_root(spark):
    leaves = merkle.leaves(spark.range(100).select(F.format_string("k%03d", "id").alias("key"), F.lit("v").alias("value")))
    nodes = merkle.levels(leaves).collect()
    assert {k: sum(n.level == k for n in nodes) for k in range(6)} == {0: 32, 1: 16, 2: 8, 3: 4, 4: 2, 5: 1}
    assert [n.hash for n in nodes if n.level == 5] == [merkle.root(leaves).first().hash]
    plan = merkle.root(leaves)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 4


def test_ranks_are_positions(spark):
    keys = [f"{i * 7919 % 1000:04}" for i in range(1000)]
    df = spark.createDataFrame([(k, 1) for k in keys], "key string, _at int").repartition(7)
    got = merkle.global_rank(df)
    assert got.columns == ["key", "_at", "rank"]
    assert [r.key for r in got.orderBy("rank").collect()] == sorted(keys)
    assert [r["rank"] for r in got.orderBy("key").collect()] == list(range(1000))


# writes


def test_request_batches(spark):
    log = spark.createDataFrame([("a", "1", 1, False)], "key string, value string, version long, tombstone boolean")
    batch = spark.range(MAX_BATCH + 1).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    with pytest.raises(InvalidEntry):
        mutate.request_batch(log, batch, "n", 1)
    rows, answer = mutate.request_batch(log, batch.limit(MAX_BATCH), "n", 1)
    assert tuple(answer.first()) == (MAX_BATCH, 0) and rows.count() == MAX_BATCH
    assert tuple(mutate.request_batch(log, batch.limit(0), "n", 1)[1].first()) == (0, 0)


def test_store_notes_the_last_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    assert s.last_version() == 0
    s.put("a", b"1", "n", 1)
    s.put("a", b"2", "n", 2, {"z": 9})
    s.delete("a", "n", 3)
    assert s.last_version() == 3 and s.entries().agg(F.max("version")).first()[0] == 3
    s.compact(10**18)
    s.truncate()
    assert s.entries().count() == 0 and s.last_version() == 3  # the old tombstone is gone, its version isn't used again
    s.put("b", b"x", "n", 4)
    assert s.table().fetch("b").version == 4
    (tmp_path / "t/log/epoch=4/_last_version").unlink()
    assert s.last_version() == 4 and s.size() > 0
    s.reset()
    assert s.epochs() == [] and s.last_version() == 0


def test_unreadable_files_fail_unless_asked(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.put("a", b"1", "n", 1)
    s.put("b", b"2", "n", 2)
    bad = next((tmp_path / "t/log/epoch=1").glob("*.parquet"))
    bad.write_bytes(b"PAR1 no parquet PAR1")
    (bad.parent / f".{bad.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        s.table().scan().collect()
    assert [r.key for r in Store(spark, str(tmp_path / "t"), ignore_corrupt=True).table().scan().collect()] == ["b"]


def test_clocks_of_concurrent_writers(spark):
    rows = [("k", f"v{i}", i, {f"n{i}": i + 1}, i) for i in range(40)] + [("k", "all", 41, {f"n{i}": 9 for i in range(5)}, 41), ("j", "x", 1, {"a": 1}, 50), ("j", "y", 0, {"a": 2}, 51), ("z", "n", 1, None, 60)]
    df = spark.createDataFrame(rows, "key string, value string, version long, vclock map<string,bigint>, seq long")
    got = {(r.key, r.value) for r in resolve.siblings(df).collect()}
    above = lambda a, b: all(b.get(n, 0) >= c for n, c in a.items()) and a != b
    want = {(k, v) for k, v, _, c, _ in rows if not any(k == k2 and above(c or {}, c2 or {}) for k2, _, _, c2, _ in rows)}
    assert got == want and ("j", "x") not in got


# replicas, health


def test_a_wide_ring_stays_narrow(spark):
    big = ring.Ring([f"node-{i}" for i in range(300)], vnodes=20)
    widths = big.lookup(spark, 3).agg(F.max(F.size("prefs")), F.count("*")).first()
    assert widths[0] == 3 and widths[1] <= 300 * 20 + 1024 + 1
    keys = spark.range(200).select(F.col("id").cast("string").alias("key"))
    got = {(r.key, r.replica_index): r.node for r in ring.replicas(keys, big, 3).collect()}
    small = {(r.key, i): n for r in ring.with_preferences(keys, big).collect() for i, n in enumerate(r.prefs[:3])}
    assert got == small


def test_fan_out_counts_what_the_coordinator_waits_for(spark):
    four = ring.Ring([f"n{i}" for i in range(4)])
    rows = spark.range(50).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).cast("long").alias("version"))
    sent, acks, hints = quorum.fan_out(rows, four, ["n0", "n1", "n2", "n3"], failed=rows.select("key", F.lit("n1").alias("replica")))
    assert sent.count() == 150 and hints.count() == sent.where("replica = 'n1'").count() > 0
    assert all(r.committed for r in acks.collect()) and {r.acks for r in acks.collect()} == {2, 3}
    sent, acks, hints = quorum.fan_out(rows, four, ["n0"])
    assert sent.where("target is not null").count() == 50 - sent.where("replica = 'n0' and target is null").count()
    assert not any(r.committed for r in acks.collect()) and hints.count() == 0
    sent, acks, hints = quorum.fan_out(rows, four, ["n0", "n1"], sloppy=False)
    assert hints.count() == sent.where("not ok").count() and sent.count() == 150


def test_rpc_breaker(spark):
    calls = [(0, False), (1, False), (5, True), (20, True), (21, True), (22, True), (50, True), (60, False), (61, False), (80, False), (81, True), (95, True), (100, True)]
    df = spark.createDataFrame([("n", i, t * 1_000_000, ok) for i, (t, ok) in enumerate(calls)], "node string, seq long, ts_us long, ok boolean")
    got = [(r.state, r.allowed) for r in health.rpc_breaker_states(df, 2, 10_000_000, 3).orderBy("seq").collect()]
    assert got == [
        ("closed", True), ("open", True), ("open", False), ("half_open", True), ("open", False), ("half_open", True), ("open", False), ("open", True),
        ("open", False), ("open", True), ("open", False), ("half_open", True), ("open", False),
    ]


def test_ratio_detector(spark):
    beats = spark.createDataFrame([("a", t * 1_000_000) for t in range(10)] + [("b", 5_000_000), ("b", 5_500_000)] + [("c", 7)] * 5, "node string, ts_us long")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    got = {r.node: (r.n, r.ratio, r.available) for r in health.ratio_suspicion(beats, 29_000_000, 4_000_000, nodes, threshold=8.0, least=3).collect()}
    assert got == {"a": (5, 20.0, False), "b": (2, 0.0, True), "c": (5, 0.0, True), "d": (0, 9.0, False)}


def test_gossip_reaches_everybody(spark):
    members = spark.createDataFrame([(f"n{i}", "alive" if i else "dead") for i in range(10)], "node string, state string")
    rounds = [{(r.node, r.peer) for r in health.gossip_round(members, 2, seed).collect()} for seed in range(6)]
    assert all(len(x) == 18 and not any(a == b or "n0" in (a, b) for a, b in x) for x in rounds)
    knows = {"n1"}
    for x in rounds:
        knows |= {b for a, b in x if a in knows}
    assert knows == {f"n{i}" for i in range(1, 10)}
    assert health.gossip_round(members.where("node = 'n3'"), 2).collect() == []


# small things


def test_words_and_addresses(spark):
    assert split_words('put key "value with  spaces" a\\ b "x\\y" \\"') == ["put", "key", "value with  spaces", "a b", "x\\y", '"']
    assert split_words("  ") == [] and split_words('a""b') == ["ab"]
    rows = [("http://h:1/x",), ("https://h/y",), ("h",), ("h:9",), ("/kv/a/b",)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string").select(with_port(F.col("a"), 5)).collect()]
    assert got[:4] == ["h:5"] * 4
    assert spark.createDataFrame(rows[-1:], "a string").select(key_from_path(F.col("a"), "/kv/")).first()[0] == "a/b"


def test_shell_and_pressure(spark, tmp_path):
    out = io.StringIO()
    lines = ['put greeting "hello world"', "get greeting", "no-such-thing", "get absent", "flush", "exit", "put never x"]
    assert main(["--root", str(tmp_path / "t"), "shell"], spark, out, lines) == 0
    text = out.getvalue()
    assert "greeting hello world 1" in text and "no such command: no-such-thing" in text and text.rstrip().endswith("1")
    assert Store(spark, str(tmp_path / "t")).epochs() == [1]
    out = io.StringIO()
    assert main(["--root", str(tmp_path / "p"), "--format", "table", "pressure", "--records", "200", "--ops", "100", "--batches", "3"], spark, out) == 0
    assert [x.split(" | ")[0] for x in out.getvalue().splitlines()] == ["write", "compact", "read"]
    assert Store(spark, str(tmp_path / "p")).table().scan().count() == 200


def test_no_local_scratch_on_a_cluster():
    from types import SimpleNamespace

    session = lambda master, place=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, x=None: place), sparkContext=SimpleNamespace(master=master, applicationId=master, getConf=lambda: SimpleNamespace(get=lambda k, x=None: None)))
    with pytest.raises(RuntimeError):
        scratch_dir(session("spark://h:7077"), "x")
    assert scratch_dir(session("yarn", "hdfs://a/b"), "x").startswith("hdfs://a/b/ledgerline/x-")
    assert scratch_dir(session("local[4]"), "x").startswith("file:")
    assert fresh(["A", "a_"], "a") == "a__"
