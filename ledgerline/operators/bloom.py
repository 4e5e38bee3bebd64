"""An explicit Bloom filter as a relation of 64-bit words (word, bits).

Parquet's own filters serve point reads; this one is for membership between
tables. It is built with a partial bit_or before the shuffle and probed by a
join on the word, so neither side is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizing(n: int, p: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for n keys at false positive rate p."""
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / max(n, 1) * math.log(2)))


def positions(key: Column, m: int, k: int) -> Column:
    """k bit positions by double hashing with two halves of the key's hash."""
    h = F.xxhash64(key)
    a, b = F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit((1 << 31) - 1)).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (a + i * b) % F.lit(m))


def build(keys: DataFrame, m: int, k: int, key: str = "key") -> DataFrame:
    bits = keys.select(F.explode(positions(F.col(key), m, k)).alias("_p"))
    word = F.expr("_p div 64").alias("word")
    return bits.select(word, F.expr("shiftleft(1L, cast(_p % 64 as int))").alias("_b")).groupBy("word").agg(F.bit_or("_b").alias("bits"))


def might_contain(probe: DataFrame, filter_words: DataFrame, m: int, k: int, key: str = "key") -> DataFrame:
    """Distinct probed keys with ``maybe``: false means certainly absent."""
    own = probe.select(key).distinct().withColumn("_p", F.explode(positions(F.col(key), m, k)))
    own = own.select(key, F.expr("_p div 64").alias("word"), F.expr("shiftleft(1L, cast(_p % 64 as int))").alias("_b"))
    hit = F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(F.col("_b")) != 0
    return own.join(filter_words, "word", "left").groupBy(key).agg(F.bool_and(hit).alias("maybe"))
