import io
import json

import pytest
from pyspark.sql import functions as F

from ledgerline import workload
from ledgerline.__main__ import main
from ledgerline.functions.hashing import scramble64
from ledgerline.operators import health, mutate, resolve
from ledgerline.operators.ring import Ring
from ledgerline.plans.store import Store
from ledgerline.sources import json_map, prometheus, wal
from ledgerline.streaming import jobs, processors


def put(store, key, value, now):
    store.append(mutate.put(store.entries(), key, value.encode(), "n1", now))


def values(store):
    return {r.key: bytes(r.value).decode() for r in store.table().scan().collect()}


def test_append_compact_truncate(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    assert values(s) == {}
    put(s, "a", "1", 1)
    put(s, "b", "2", 2)
    put(s, "a", "3", 3)
    rows, _ = mutate.delete(s.entries(), spark.createDataFrame([("b",)], "key string"), "n1", 4)
    s.append(rows)
    before = values(s)
    assert before == {"a": "3"}
    assert s.compact(5) == 4 and values(s) == before
    assert s.entries().where("key = 'b' and tombstone").count() == 1  # young
    put(s, "b", "again", 6)
    assert values(s) == {"a": "3", "b": "again"}
    assert s.compact(7 + 10**15) == 5 and s.truncate() == 6
    assert values(s) == {"a": "3", "b": "again"} and (s.epochs(), s.snapshots()) == ([], [5])
    assert {r.level: r.entries for r in s.stats().collect()} == {"snapshot": 2}
    put(s, "c", "x", 8)
    assert s.epochs() == [6] and s.entries(since_epoch=5).count() == 1


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    put(s, "a", "1", 1)
    put(s, "a", "2", 2)
    (tmp_path / "t/log/epoch=2/_SUCCESS").unlink()
    assert values(s) == {"a": "1"}


def test_wal_lines(spark, tmp_path):
    path = tmp_path / "wal"
    path.mkdir()
    lines = [{"op": "PUT", "key": "k", "value": "djE=", "ver": 1, "ts": 5, "vc": {"n": 1}}, {"op": "DEL", "key": "k", "ver": 2, "ts": 6}]
    (path / "a.json").write_text("\n".join([json.dumps(lines[0]), "{torn", json.dumps(lines[1]), "", '{"op":"HM","key":"x"}']))
    got = wal.replay(spark, str(path))
    assert [(r.key, r.version, r.tombstone, r.vclock) for r in got.orderBy("version").collect()] == [("k", 1, False, {"n": 1}), ("k", 2, True, None)]
    assert wal.max_version(spark, str(path)) == 2 and state_of(got) == {}
    assert wal.compact(spark, str(path), str(tmp_path / "w2"), 1) == 1
    wal.append(got, str(tmp_path / "w3"))
    assert sorted(map(str, wal.replay(spark, str(tmp_path / "w3")).collect())) == sorted(map(str, got.collect()))


def state_of(df):
    return {r.key: r.value for r in resolve.live(df).collect()}


def test_prometheus(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# HELP a b\na_total{op="get",le="+Inf"} 3 1700000000000\nup 1\nbad line here x\nlat NaN\ninf +Inf\n')
    got = {r.name: (r.labels, r.value, r.ts_ms) for r in prometheus.scrape(spark, str(tmp_path / "m.txt")).collect()}
    assert got["a_total"] == ({"op": "get", "le": "+Inf"}, 3.0, 1700000000000) and got["up"] == ({}, 1.0, None)
    assert got["inf"][1] == float("inf") and "bad" not in got


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b'x"y')), ("é", bytearray("日".encode()))], "key string, value binary")
    json_map.write_export(df, str(tmp_path / "out"))
    back = json_map.read_import(spark, str(tmp_path / "out"))
    assert {(r.key, bytes(r.value)) for r in back.collect()} == {("a", b'x"y'), ("é", "日".encode())}


def test_cli(spark, tmp_path):
    def run(*args):
        out = io.StringIO()
        return main(["--root", str(tmp_path / "t"), *args], spark, out), out.getvalue()

    assert run("put", "a", "1")[0] == 0 and run("put", "b", "2")[0] == 0
    assert run("get", "a") == (0, "a 1 1\n")
    assert run("--format", "json", "scan")[1] == '{"key": "a", "value": "1", "version": 1}\n{"key": "b", "value": "2", "version": 2}\n'
    assert run("delete", "a")[0] == 0 and run("get", "a")[0] == 1 and run("put", "", "x")[0] == 1
    (tmp_path / "in.json").write_text('{\n "c": "3",\n "d": "4"\n}')
    assert run("import", str(tmp_path / "in.json"))[1] == "rejected 0\n"
    assert run("compact")[0] == 0 and run("keys")[1].split() == ["b", "c", "d"] and run("exists", "b")[1] == "b True\n"
    assert run("export", str(tmp_path / "out"))[0] == 0 and run("stats")[0] == 0


def test_workloads(spark):
    n, ops = 1000, 4000
    for name, p in workload.PROFILES.items():
        log = workload.operations(spark, p, n, ops)
        again = workload.operations(spark, p, n, ops).repartition(5)
        assert sorted(map(str, log.collect())) == sorted(map(str, again.collect()))
        share = {r.op: r["count"] * 100 / ops for r in log.groupBy("op").count().collect()}
        for op in ("read", "update", "insert", "scan", "rmw"):
            assert abs(share.get(op, 0) - getattr(p, op)) < 4, name
        assert log.where("op <> 'insert' and (record < 0 or record >= 1000)").count() == 0
    top = workload.operations(spark, workload.PROFILES["C"], n, ops).groupBy("record").count().agg(F.max("count")).first()[0]
    assert top > 20 * ops / n
    out = {r.op: (r.n, r.found) for r in workload.run(workload.preload(spark, n), workload.operations(spark, workload.PROFILES["F"], n, ops)).collect()}
    assert out["read"][0] == out["read"][1] and out["rmw"][0] + out["read"][0] == ops
    u = spark.range(1000).select(workload.uniform(1, "u", F.col("id")).alias("u"))
    assert u.select(workload.power_law(F.col("u"), 100).alias("x")).where("x < 0 or x > 99").count() == 0
    assert u.select(workload.log_uniform(F.col("u"), 100).alias("x")).where("x < 0 or x > 99").count() == 0


def test_scramble_wraps(spark):
    def fnv(x):
        h = 0xCBF29CE484222325
        for b in (x % 2**64).to_bytes(8, "little"):
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h & (2**63 - 1)

    got = spark.createDataFrame([(x,) for x in (0, 1, -1, 10**12)], "x long").select("x", scramble64(F.col("x")).alias("h")).collect()
    assert all(r.h == fnv(r.x) for r in got)


@pytest.fixture
def files(spark, tmp_path):
    """Entries in three files, to stream one by one."""
    rows = [(f"k{i % 9}", bytearray(str(i).encode()), i, i * 10, i % 7 == 0, None, "n", i) for i in range(90)]
    from ledgerline.model import ENTRY

    for part in range(3):
        spark.createDataFrame(rows[part::3], ENTRY).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return str(tmp_path / "log"), rows


def drain(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams_equal_batch(spark, files, tmp_path):
    processors.use_rocksdb(spark)
    path, rows = files
    log = jobs.log_stream(spark, path, 1)
    got = drain(processors.latest_stream(log.select("key", "version", F.col("value").cast("string").alias("value"), "tombstone")), "update", "latest", tmp_path)
    last = got.groupBy("key").agg(F.max("version").alias("version"))
    batch = resolve.winners(spark.read.parquet(path)).select("key", "version")
    assert sorted(map(str, last.collect())) == sorted(map(str, batch.collect()))

    events = "key as node, seq, ts_ns * 100000 as ts_us, not tombstone as ok"
    one = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).selectExpr(*events.split(", "))
    got = drain(processors.breaker_stream(one, 2, 5_000_000, 1), "append", "breaker", tmp_path)
    want = health.breaker_states(spark.read.parquet(path).selectExpr(*events.split(", ")), 2, 5_000_000, 1)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_expiry_stream(spark, tmp_path):
    processors.use_rocksdb(spark)
    rows = [("a", 1, 5_000, 1_000), ("b", 2, 90_000, 1_100), ("a", 3, 7_000, 1_200), ("z", 4, 10**9, 60_000)]
    for r in rows[:2], rows[2:3], rows[3:]:
        spark.createDataFrame(r, "key string, seq long, expire_ms long, ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    src = spark.readStream.schema("key string, seq long, expire_ms long, ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    timed = src.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", "0 seconds").select("key", "seq", "expire_ms", "ts")
    got = drain(processors.expiry_stream(timed), "append", "expiry", tmp_path)
    assert {(r.key, r.seq, r.expire_ms) for r in got.collect()} == {("a", 3, 7_000)}


def test_ingest_replicate_and_rates(spark, files, tmp_path):
    path, rows = files
    jobs.ingest(jobs.log_stream(spark, path, 1), str(tmp_path / "sink"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == len(rows)
    jobs.replicate(jobs.log_stream(spark, path), Ring(["a", "b", "c", "d"]), str(tmp_path / "peers"), str(tmp_path / "c2")).awaitTermination()
    sent = spark.read.parquet(str(tmp_path / "peers/batch=0"))
    assert sent.count() == 27 and set(sent.columns) >= {"peer", "key", "version"}
    ev = spark.readStream.schema("ts timestamp_ntz, event_type string, user_id long").parquet("/root/testdata/sf0.001/events.parquet*")
    own = ev.withColumn("operation", F.col("event_type")).withColumn("status", F.col("event_type"))
    got = drain(jobs.rates(own, "1 hour", late="1 minute"), "complete", "rates", tmp_path)
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").count()
    assert got.count() == batch.count() and got.agg(F.sum("n")).first()[0] == 1000


def test_binary_logs(spark, tmp_path):
    from ledgerline.sources import binary_log as bl

    rows = [{"key": f"k{i}", "value": b"v" * i, "version": i, "ts_ns": 10 * i, "tombstone": i % 3 == 0} for i in range(9)]
    good = b"".join(map(bl.write_record, rows))
    (tmp_path / "a.log").write_bytes(good + b"\x05\x00\x00\x00to")
    got = bl.read_log(spark, str(tmp_path / "a.log")).orderBy("place").collect()
    assert [(r.key, bytes(r.value), r.version, r.ts_ns, r.tombstone) for r in got] == [(r["key"], r["value"], r["version"], r["ts_ns"], r["tombstone"]) for r in rows]
    (tmp_path / "b.log").write_bytes(good[:60] + b"\xff" * 9 + good)
    assert bl.read_log(spark, str(tmp_path / "b.log")).count() < 9
    assert {r.key for r in bl.read_log(spark, str(tmp_path / "b.log"), resync=True).collect()} >= {r["key"] for r in rows}
    (tmp_path / "empty.log").write_bytes(b"")
    assert bl.read_log(spark, str(tmp_path / "empty.log")).count() == 0


def test_logs_of_whole_batches(spark, tmp_path):
    from ledgerline.sources import binary_log as bl

    n = 2 * bl._BATCH  # the last batch of a file is empty
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"op": "PUT", "key": f"k{i}", "ver": i}) for i in range(n)))
    (tmp_path / "b.log").write_bytes(b"".join(bl.write_record({"key": f"k{i}", "version": i, "ts_ns": 0, "tombstone": False}) for i in range(n)))
    (tmp_path / "c.log").write_bytes(b"")
    got = bl.read_log(spark, str(tmp_path)).coalesce(1).collect()
    assert sorted((r.file[-6:], r.place, r.key) for r in got) == sorted((f, i, f"k{i}") for f in ("a.json", "/b.log") for i in range(n))


def test_log_files_are_rolled(spark, tmp_path, monkeypatch):
    from ledgerline.sources import binary_log as bl
    from ledgerline.sources import wal

    monkeypatch.setattr(wal, "SEGMENT", 10)
    i = F.col("id")
    rows = spark.range(35, numPartitions=1).select(F.concat(F.lit("k"), i).alias("key"), F.lit("v").alias("value"), i.alias("version"), i.alias("ts_ns"), F.lit(False).alias("tombstone"))
    wal.append(rows, str(tmp_path / "log"))
    got = bl.read_log(spark, str(tmp_path / "log/*.json")).collect()
    assert sorted(r.version for r in got) == list(range(35)) == sorted(r.version for r in wal.replay(spark, str(tmp_path / "log")).collect())
    assert len({r.file for r in got}) == 4 and max(r.place for r in got) == 9


def test_table_files(spark, tmp_path):
    import struct

    import zstandard

    from ledgerline.sources import binary_log as bl

    def entry(key, value, version, dead, clock):
        vc = struct.pack("<I", len(clock)) + b"".join(struct.pack("<H", len(k)) + k.encode() + struct.pack("<Q", n) for k, n in clock.items()) if clock else b""
        return b"\xbf" + struct.pack("<I", len(key)) + key.encode() + struct.pack("<I", len(value)) + value + struct.pack("<QqB", version, 77, dead) + struct.pack("<I", len(vc)) + vc

    blocks = [(entry("a", b"1" * 500, 1, 0, {"n1": 2, "n2": 3}), True), (entry("b", b"", 2, 1, {}), False), (b'{"Key":"c","Value":"eA==","Version":3,"TimeStamp":"1970-01-01T00:00:01.5Z","Tombstone":false,"VectorClock":null}', False)]
    out, index = b"", []
    for (data, packed), key in zip(blocks, "abc"):
        data = zstandard.compress(data) if packed else data
        index.append({"k": key, "o": len(out), "s": len(data) + 4, "c": packed, "b": key != "c"})
        out += struct.pack("<I", len(data)) + data
    tail = json.dumps(index).encode()
    (tmp_path / "L2_001.sst").write_bytes(out + tail + b"bloom" + struct.pack("<QQQQ", len(out), len(tail), len(out) + len(tail), 5))
    got = {r.key: r for r in bl.read_tables(spark, str(tmp_path / "L2_001.sst")).collect()}
    assert got["a"].vclock == {"n1": 2, "n2": 3} and bytes(got["a"].value) == b"1" * 500 and got["a"].level == 2
    assert got["b"].tombstone and got["b"].vclock is None and got["b"].ts_ns == 77
    assert bytes(got["c"].value) == b"x" and got["c"].ts_ns == 1_500_000_000
