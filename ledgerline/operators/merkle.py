"""Merkle trees over sorted keys.

Keys are ranked and cut into 2^d leaves of at most four keys (d is the least
that allows it; leaf j begins at rank floor(n j / 2^d)). A leaf hashes its
length-prefixed keys and values, a parent its two children. Ranks come from
sorted ranges of keys that are written and counted; no window runs over the
whole table. Many levels are folded inside a group, so a tree needs an exchange
for each ten levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import fresh, scratch_dir

LEAF_KEYS = 4


def depth_for(n: int) -> int:
    d = 0
    while n > LEAF_KEYS << d:
        d += 1
    return d


def global_rank(df: DataFrame, key: str = "key", name: str = "rank") -> DataFrame:
    """``df`` (one row for each key) with the rank of its key, from 0.

    Ranges of keys are sorted and written with each row's place in its range;
    the ranges' sizes, one row each, give the rank. The input is computed once
    and its rows move once.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = fresh(df.columns, "_at")
    path = scratch_dir(spark, "ranked")
    df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn(at, F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    part = fresh(df.columns, "_part")
    offsets = spark.createDataFrame(before, f"{part} long, _before long")  # one row for each range
    ranked = placed.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(offsets), part)
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.select(*df.columns, (place + F.col("_before")).alias(name))


def record(key: str = "key", value: str = "value"):
    """A key and value as one unambiguous string: each behind its length."""
    v = F.coalesce(F.col(value).cast("string"), F.lit(""))
    return F.concat(F.octet_length(key).cast("string"), F.lit(":"), F.col(key), F.octet_length(v).cast("string"), F.lit(":"), v)


def leaves(state: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """leaf, n_keys, first_key, last_key, hash of each leaf."""
    return _leaves(state, key, value).drop("keys")


def _leaves(state: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    ranked = global_rank(state.select(key, record(key, value).alias("_rec")), key)
    n = ranked.count()
    leaf = F.expr(f"((rank + 1) * {1 << depth_for(n)} - 1) div {max(n, 1)}").alias("leaf")
    rows = ranked.select(leaf, F.struct(key, "_rec").alias("_e"))
    listed = F.array_sort(F.collect_list("_e"))  # LEAF_KEYS at most
    out = rows.groupBy("leaf").agg(F.count("*").alias("n_keys"), listed.alias("_l"))
    text = F.array_join(F.transform("_l", lambda e: e["_rec"]), "")
    return out.select("leaf", "n_keys", F.element_at("_l", 1)[key].alias("first_key"), F.element_at("_l", -1)[key].alias("last_key"), F.sha2(text, 256).alias("hash"), F.transform("_l", lambda e: e[key]).alias("keys"))


#: Levels that are folded in one group: 2^FOLD hashes.
FOLD = 10


def fold(nodes: DataFrame, steps: int) -> DataFrame:
    """The nodes (idx, hash) ``steps`` levels up; up to 2^steps hashes meet in a
    group, and each level is computed there."""
    listed = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    rows = nodes.groupBy(F.shiftright("idx", steps).alias("idx")).agg(F.transform(listed, lambda e: e["hash"]).alias("_h"))
    for _ in range(steps):
        pair = "transform(sequence(0, (size(_h) + 1) div 2 - 1), i -> sha2(concat(_h[2 * i], coalesce(get(_h, 2 * i + 1), '')), 256))"
        rows = rows.select("idx", F.expr(pair).alias("_h"))
    return rows.select("idx", F.element_at("_h", 1).alias("hash"))


def levels(leaf_rows: DataFrame) -> DataFrame:
    """level, idx, hash of all nodes; level 0 are the leaves, the last the root.
    Each level is written, half as many rows each time, and read by the next."""
    spark = leaf_rows.sparkSession
    level, out, n, k = leaf_rows.select(F.col("leaf").alias("idx"), "hash"), None, None, 0
    while True:
        path = scratch_dir(spark, "level")
        level.write.parquet(path)
        level = spark.read.parquet(path)
        n = level.count() if n is None else (n + 1) // 2
        own = level.select(F.lit(k).alias("level"), "idx", "hash")
        out = own if out is None else out.unionAll(own)
        if n < 2:
            return out
        level, k = fold(level, 1), k + 1


def root(leaf_rows: DataFrame) -> DataFrame:
    """One row: hash and n_leaves; no row for an empty table."""
    spark = leaf_rows.sparkSession
    path = scratch_dir(spark, "leaves")
    leaf_rows.select(F.col("leaf").alias("idx"), "hash").write.parquet(path)
    nodes = spark.read.parquet(path)
    n = nodes.count()
    depth = max(0, n - 1).bit_length()
    while depth:
        nodes, depth = fold(nodes, min(FOLD, depth)), depth - min(FOLD, depth)
    return nodes.select("hash", F.lit(n).cast("long").alias("n_leaves"))


def positional_diff(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys in leaves whose hashes differ at the same place of two trees. If one
    tree is deeper, its nodes at the depth of the other's leaves are compared,
    and the other's leaves give the keys; an empty tree differs everywhere."""
    x, y = (_leaves(t, key, value) for t in (a, b))
    sizes = [t.count() for t in (x, y)]
    if not all(sizes):
        return (x if sizes[0] else y).select(F.explode("keys").alias(key))
    m, n = ((size - 1).bit_length() for size in sizes)
    sides = []
    for t, deeper in ((x, m - n), (y, n - m)):
        if deeper > 0:
            nodes = t.select(F.col("leaf").alias("idx"), "hash")
            while deeper:
                nodes, deeper = fold(nodes, min(FOLD, deeper)), deeper - min(FOLD, deeper)
            t = nodes.select(F.col("idx").alias("leaf"), "hash", F.array().cast("array<string>").alias("keys"))
        sides.append(t.select("leaf", "hash", "keys"))
    p, q = sides[0], sides[1].toDF("leaf", "_other", "_keys")
    uneven = p.join(q, "leaf", "full_outer").where(~F.col("hash").eqNullSafe(F.col("_other")))
    none = F.array().cast("array<string>")
    return uneven.select(F.explode(F.array_union(F.coalesce("keys", none), F.coalesce("_keys", none))).alias(key))


def bucket_hashes(state: DataFrame, buckets: int = 1024, key: str = "key", value: str = "value") -> DataFrame:
    """bucket, n_keys, digest: an order-free digest for trees that are compared
    across replicas. Buckets depend on the key only, so trees always align. The
    digest adds the keys' hashes and so combines before the shuffle."""
    h = F.sha2(record(key, value), 256)
    part = lambda i: F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)")
    rows = state.select(F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(buckets)).alias("bucket"), part(1).alias("a"), part(16).alias("b"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n_keys"), F.concat_ws("-", F.sum("a").cast("string"), F.sum("b").cast("string")).alias("digest"))


def diff(a: DataFrame, b: DataFrame, buckets: int = 1024) -> DataFrame:
    """key, side (a, b or both) of the keys that differ. Only keys in buckets
    whose digests differ are compared."""
    x, y = bucket_hashes(a, buckets), bucket_hashes(b, buckets).withColumnRenamed("digest", "other")
    uneven = x.join(y.select("bucket", "other"), "bucket", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select("bucket")
    cut = lambda df, name: df.withColumn("bucket", F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(buckets))).join(F.broadcast(uneven), "bucket", "left_semi").select("key", record().alias(name))  # noqa: E731  at most `buckets` rows
    both = cut(a, "_a").join(cut(b, "_b"), "key", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("key", F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b").otherwise("both").alias("side"))
