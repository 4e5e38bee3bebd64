"""Verified near-duplicate links: texts whose sets of word shingles are alike.

A link joins two distinct texts whose sets of ``shingle``-word shingles (ASCII
letters in lower case; a shorter text is one shingle) have a Jaccard similarity
of at least ``similarity``.

* Candidates come from min-hashes: ``BANDS`` bands of ``ROWS`` minima. Two texts
  of similarity 0.8 share a band with probability 1 - (1 - 0.8^4)^20, which is
  0.99997; more alike texts with a higher one.
* The texts of a bucket are compared with its smallest and its largest text, so
  candidates grow with the texts and never with the square of a bucket. Two
  texts between these may be missed where neither is like the ends, unless they
  meet in another band.
* Every candidate is verified on the two whole sets of shingles, so no link is
  wrong; how many are found is measured in the tests and the README.

Texts are known by a 64-bit hash; equal texts are one. Null texts, and texts
without words, have no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, Lexed, as_bytes, cut, map_batches, mix64, runs_by_size, slices, then_released

BANDS, ROWS = 20, 4
_SALTS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def shingle_sets(texts: list[bytes], shingle: int = 5, seed: int = 42) -> list[np.ndarray]:
    """The distinct XXH64 hashes of each text's word shingles, in order."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    digest = xxhash.xxh64_intdigest
    for lo, hi in runs_by_size(texts, 1 << 18):
        lx = Lexed(texts[lo:hi], lower_ascii=True)
        norm = lx.norm.tobytes()
        for t in range(hi - lo):
            a, b = int(lx.first[t]), int(lx.first[t + 1])
            if a < b:
                n = max(1, b - a - shingle + 1)
                starts, ends = lx.start[a : a + n].tolist(), lx.end[min(b, a + shingle) - 1 : b].tolist()
                out[lo + t] = np.unique(np.fromiter((digest(norm[i:j], seed) for i, j in zip(starts, ends)), np.uint64, n))
    return out


def buckets_of(own: np.ndarray) -> np.ndarray:
    """A hash for each band of a set's min-hashes."""
    least = np.full(len(_SALTS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), 4096):  # a slab at a time, however long a text is
        least = np.minimum(least, mix64(own[a : a + 4096, None] ^ _SALTS[None, :]).min(axis=0))
    band = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = mix64(out ^ band[:, r]) + np.uint64(r)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar_links(df: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Distinct verified links (a, b), a below b: hashes (long) of two texts."""
    own = df.select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("_text")).where("_text is not null")

    def bands(batches):
        seen: set[int] = set()  # a task's copies of a text are one
        for b in slices(batches):
            texts = as_bytes(b.column(1))
            new = [i for i, h in enumerate(b.column(0).to_pylist()) if not (h in seen or seen.add(h))]
            keys, found = [], []
            for i, s in zip(new, shingle_sets([texts[i] for i in new], shingle)):
                if len(s):
                    keys += [b.column(0)[i].as_py()] * BANDS
                    found.append(buckets_of(s))
            bucket = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bucket.view(np.int64))], ["h", "bucket"])

    dealt = cut(own.mapInArrow(then_released(bands), "h long, bucket long"), "bands")
    # what a hot bucket or text is joined with is written first, so that Spark may split it
    ends = cut(dealt.groupBy("bucket").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi"), "ends")
    met = dealt.join(ends, "bucket")
    pairs = met.select(F.col("lo").alias("a"), F.col("h").alias("b")).unionAll(met.select(F.col("h").alias("a"), F.col("hi").alias("b")))
    pairs = cut(pairs.where("a < b").distinct(), "candidates")
    wanted = cut(pairs.select(F.col("a").alias("h")).unionAll(pairs.select(F.col("b").alias("h"))).distinct(), "wanted")
    texts = cut(own.join(wanted, "h", "left_semi"), "candidate_copies").groupBy("h").agg(F.min("_text").alias("_text"))
    texts = cut(texts, "candidate_texts")
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("_text").alias("_one")), "a").join(texts.select(F.col("h").alias("b"), F.col("_text").alias("_two")), "b")

    def verify(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = {}
        for c in (0, 1):
            own, texts = b.column(c).to_pylist(), b.column(c + 2)
            first = {h: i for i, h in reversed(list(enumerate(own))) if h not in sets}
            sets |= dict(zip(first, shingle_sets([texts[i].as_py() or b"" for i in first.values()], shingle)))
        same = [jaccard(sets[x], sets[y]) >= similarity for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    return map_batches(both.select("a", "b", "_one", "_two"), verify, "a long, b long", SLICE)
