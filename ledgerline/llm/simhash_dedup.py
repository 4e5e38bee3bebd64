"""SimHash near-duplicate components by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= radius have a value between them that is at
most radius / 2 from both. So every distinct fingerprint emits all variants
within half the radius, and every pair of linked fingerprints collides on a
variant; fingerprints that collide on a variant are in turn linked.

* Variants are shuffled by their leading bits. A fingerprint has 2081 variants
  within 2 of 64 bits but only 1 + p + p(p-1)/2 different p-bit heads, so it is
  sent once for each head and the variants under a head are enumerated there.
  Heads grow with the fingerprints, so what meets under a head doesn't.
* A head with many fingerprints is split by further bits until its variants
  fit a fixed slab; a full variant is hit by 2081 fingerprints at most, so one
  large group of near copies cannot fill a slab.
* Fingerprints on a variant form a star around the smallest of them, never all
  pairs. Star edges are deduplicated and verified by their distance.
* Components come from alternating large-star and small-star rounds over those
  edges, in DataFrame operations, each round cut to the shared folder.

Copies with one fingerprint are one row throughout; documents meet their
component in one join at the end, which Spark may split for a hot fingerprint.

Defined results: null and empty texts have fingerprint zero and are linked like
others. A component's id is its smallest non-null doc id (null if it has none).
Repeated rows are rows of the same component. Extra columns are ignored
whatever their names. An empty table gives an empty table. A text is hashed whole
in one task; bits are counted in slabs of shingles, however long it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, Lexed, as_bytes, cut, map_batches, runs_by_size, shuffle_partitions, then_released

BITS = 64
SLAB = 1 << 21
BIT_ROWS = 1 << 16
_U = np.uint64


def fingerprints_of(texts: list[bytes], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned SimHash of each text (majority of the bits of XXH64 shingles)."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    powers = _U(1) << np.arange(BITS, dtype=np.uint64)
    for lo, hi in runs_by_size(texts, 1 << 18):
        lx = Lexed(texts[lo:hi], lower_ascii=True)
        n_words = np.diff(lx.first)
        n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(lx.first[:-1] - (np.cumsum(n) - n), n) + np.arange(total)
        last = np.minimum(at + shingle, np.repeat(lx.first[1:], n)) - 1
        norm = lx.norm.tobytes()
        h = np.fromiter((digest(norm[a:b], seed) for a, b in zip(lx.start[at].tolist(), lx.end[last].tolist())), np.uint64, total)
        some = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[some]
        counts = np.zeros((len(some), BITS), np.int64)
        for a in range(0, total, BIT_ROWS):  # bits of a slab of shingles at a time, however long a text is
            b = min(total, a + BIT_ROWS)
            i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b)
            bits = np.unpackbits(h[a:b].astype("<u8").view(np.uint8).reshape(b - a, 8), axis=1, bitorder="little")
            counts[i:j] += np.add.reduceat(bits, np.maximum(first[i:j], a) - a, axis=0, dtype=np.int64)
        out[lo + some] = ((2 * counts > n[some, None]).astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``id_col`` and fp (the fingerprint as a signed long) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints_of(as_bytes(b.column(1)), shingle, seed)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["_id", "fp"])

    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return map_batches(docs, fn, f"_id {kind}, fp long", SLICE).withColumnRenamed("_id", id_col)


def flips(width: int, most: int) -> np.ndarray:
    """All masks of up to ``most`` (at most 2) of the lowest ``width`` bits."""
    one = _U(1) << np.arange(width, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    if most >= 1:
        out.append(one)
    if most >= 2:
        i, j = np.triu_indices(width, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def _head(x: np.ndarray, p: int) -> np.ndarray:
    return x >> _U(BITS - p) if p else np.zeros_like(x)


def stars(fps: np.ndarray, head: int, p: int, half: int) -> np.ndarray:
    """Star edges (smallest, other) of the fingerprints that collide on a
    variant under the p-bit ``head``, as distinct rows of two columns."""
    found, todo = [], [(fps, head, p)]
    while todo:
        fps, head, p = todo.pop()
        used = np.bitwise_count(_head(fps, p) ^ _U(head))
        fps, used = fps[used <= half], used[used <= half]
        if len(fps) < 2:
            continue
        low = BITS - p
        sizes = [1, 1 + low, 1 + low + low * (low - 1) // 2]
        if p < BITS and sum(sizes[half - f] * int((used == f).sum()) for f in range(half + 1)) > SLAB:
            todo += [(fps, 2 * head, p + 1), (fps, 2 * head + 1, p + 1)]
            continue
        top = _U((head << low) & (2**BITS - 1))
        keep = _U((1 << low) - 1)
        variants, owners = [], []
        for f in range(half + 1):
            own = fps[used == f]
            if len(own):
                v = ((own & keep) | top)[:, None] ^ flips(low, half - f)[None, :]
                variants.append(v.ravel())
                owners.append(np.repeat(own, v.shape[1]))
        v, o = np.concatenate(variants), np.concatenate(owners)
        s = np.sort(v)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            continue
        near = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = twice[near] == v
        v, o = v[hit], o[hit]
        order = np.lexsort((o, v))
        v, o = v[order], o[order]
        new = np.concatenate(([True], v[1:] != v[:-1]))
        centre = o[np.flatnonzero(new)][np.cumsum(new) - 1]
        found.append(np.unique(np.stack((centre, o), axis=1)[centre != o], axis=0))
    edges = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
    return edges[np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 2 * half]


def links(fps: DataFrame, radius: int = 4, head_bits: int | None = None) -> DataFrame:
    """Distinct star edges (a, b), a below b unsigned, between the distinct
    fingerprints ``fps`` (column fp): they connect what lies within ``radius``."""
    if radius not in (2, 4):
        raise ValueError("the radius must be 2 or 4")
    half = radius // 2
    spark = fps.sparkSession
    if head_bits is None:  # aim at some four slabs under a head
        head_bits = min(32, max(6, (fps.count() * 2081 // (4 * SLAB)).bit_length() + 2))

    def send(batches):
        masks = flips(head_bits, half)
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            heads = (_head(own, head_bits)[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(heads, kind="stable")
            heads, sent = heads[order], np.repeat(own, len(masks))[order]
            new = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
            ends = np.append(new[1:], len(heads))
            blobs = [sent[a:e].astype("<u8").tobytes() for a, e in zip(new.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(heads[new].astype(np.int64)), pa.array(blobs, pa.binary())], ["head", "blob"])

    def meet(t: pa.Table) -> pa.Table:
        own = np.unique(np.frombuffer(b"".join(t["blob"].to_pylist()), "<u8"))
        e = stars(own, t["head"][0].as_py(), head_bits, half)
        return pa.table({"a": pa.array(e[:, 0].astype(np.uint64).view(np.int64)), "b": pa.array(e[:, 1].astype(np.uint64).view(np.int64))})

    dealt = fps.repartition(shuffle_partitions(spark), "fp").mapInArrow(then_released(send), "head long, blob binary")
    return dealt.groupBy("head").applyInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "star") -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest
    node of the component. Large-star and small-star rounds until nothing
    changes; each round is written to the shared folder."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(now)
    while before[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that Spark may split the join for a centre with many edges
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct(), name)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``id_col``, fp (signed long), component_id of every row of ``df``."""
    own = cut(fingerprints(df, id_col, text_col, shingle, seed), "fingerprints")
    each = own.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = components(links(each.select("fp"), radius))
    each = cut(each.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    # a large component: its minimum combines before the shuffle, and Spark may split the join
    least = cut(each.groupBy("root").agg(F.min("_least").alias("component_id")), "least")
    named = each.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select(id_col, "fp", "component_id")
