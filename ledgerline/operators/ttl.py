"""Time to live. A key's timer is its latest; it expires strictly before now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timers(ttl: DataFrame) -> DataFrame:
    """One timer for each key: adding a key again replaces its timer."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return ttl.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def expired(ttl: DataFrame, now_ns: int) -> DataFrame:
    """Expired timers in order of expiry."""
    return timers(ttl).where(F.col("expire_at_ns") < now_ns).orderBy("expire_at_ns", "key")


def lookup(wanted: DataFrame, ttl: DataFrame, now_ns: int) -> DataFrame:
    """key, is_expired, expire_at_ns; an unknown key counts as expired."""
    own = timers(ttl.join(wanted.select("key").distinct(), "key", "left_semi")).select("key", "expire_at_ns")
    return wanted.join(own, "key", "left").withColumn("is_expired", F.coalesce(F.col("expire_at_ns") < now_ns, F.lit(True)))
