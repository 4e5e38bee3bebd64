import random

from pyspark.sql import functions as F

from ledgerline.llm.topk_search import topk_search


def brute(rows, k, ids):
    import math

    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, qv) in enumerate(good):
        if ids(q):
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(qv, v)))), i) for b, (i, v) in enumerate(good) if a != b)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, k, mod, kind="float", **kw):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"vec_id long, embedding array<{kind}>, score int, shard int, rank int")
    return sorted(tuple(r) for r in topk_search(df, F.col("vec_id") % mod == 0, k=k, **kw).collect())


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.randrange(-64, 64) / 32 for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(100)]
    rows += [(5000, None), (5001, [1.0, None, 1.0, 1.0]), (5002, [float("nan")] * 4), (5003, [float("inf"), 0.0, 0.0, 0.0]), (5004, []), (5005, [2.0]), (None, [1.0] * 4), (20, [0.5] * 4), (21, [0.5] * 4)]
    for kw in ({}, {"shard_rows": 7, "block_rows": 3, "fan_in": 2, "broadcast_bytes": 200}):
        assert run(spark, rows, 10, 20, **kw) == brute(rows, 10, lambda i: i % 20 == 0)


def test_few_candidates_large_values_and_empty(spark):
    assert run(spark, [], 10, 2) == []
    assert run(spark, [(2, [1.0])], 10, 2) == []
    rows = [(0, [3e12, -1.0]), (1, [2e12, 7.0]), (2, [1e300, 1.0]), (3, [-1.0, -1.0])]
    assert run(spark, rows, 10, 2, "double") == brute(rows, 10, lambda i: i % 2 == 0)


def test_repeated_ids_are_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (0, [-1.0, 2.0])]
    got = run(spark, rows, 10, 2)
    assert got == brute(rows, 10, lambda i: i % 2 == 0) and len(got) == 9
    assert run(spark, rows, 10, 2, shard_rows=1, block_rows=1) == got
    big = [(0, [1e20, 1.0]), (1, [3e16, 0.0]), (2, [1e307, 1.0])]
    assert run(spark, big, 10, 2, "double") == brute(big[:2], 10, lambda i: i % 2 == 0)
