"""Which entry of a key wins: by arrival, by version, or by causality.

A tombstone wins like any entry and then hides its key, so live() filters after
the winner is chosen. Predicates on the key pass below the window; the filter
on tombstones cannot. Ties are broken by a total order, so results depend
neither on partitioning nor on file order. Tables need the columns of the
order in use: version, ts_ns, seq and node, whichever exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vclock
from ..plans.scratch import written


def version_order(df: DataFrame) -> list[Column]:
    return [F.desc(c) for c in ("version", "ts_ns", "seq", "node") if c in df.columns]


def arrival_order(df: DataFrame) -> list[Column]:
    return [F.desc(c) for c in ("seq", "node") if c in df.columns]


def winners(log: DataFrame, rule: str = "version", keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The winning entry of each key, tombstones included.

    ``version``: greatest version. ``arrival``: last to arrive. ``causal``:
    among the entries that no other happened after, the greatest version.
    """
    if rule == "causal":
        return winners(siblings(log, keys), "version", keys)
    order = {"version": version_order, "arrival": arrival_order}[rule](log)
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def live(log: DataFrame, rule: str = "version") -> DataFrame:
    return winners(log, rule).where(~F.coalesce(F.col("tombstone"), F.lit(False)))


def siblings(log: DataFrame, keys: tuple[str, ...] = ("key",), clock: str = "vclock") -> DataFrame:
    """The entries that no entry of the same key strictly happened after.

    Equal clocks of a key are reduced to their winner first. Entries are then
    compared with the champions of their key (the entries with the greatest
    counter of each node, so about as many as nodes), which removes nearly all
    that is dominated; the survivors are compared among themselves. That is
    exact: whatever dominates an entry survives or is dominated by a survivor.
    Entries join one short array for each key and never each other.
    """
    entries = F.array_sort(F.map_entries(F.map_filter(F.coalesce(F.col(clock), vclock.empty()), lambda _, v: v > 0)))
    marked = log.withColumn("_form", entries)
    w = Window.partitionBy(*keys, "_form").orderBy(*version_order(log))
    one = written(marked.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank"), "clocks")
    tops = one.select(*keys, F.explode("_form").alias("_e")).groupBy(*keys, F.col("_e.key").alias("_node")).agg(F.max("_e.value").alias("_top"))
    tops = tops.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_node", "_top"))).alias("_tops"))  # as long as the nodes
    leads = F.exists("_form", lambda e: F.element_at("_tops", e["key"]) == e["value"])
    champions = one.select(*keys, "_form").join(tops, list(keys)).where(leads).groupBy(*keys).agg(F.collect_set("_form").alias("_champions"))
    left = written(_undominated(one, champions, keys, clock), "undominated")
    survivors = left.groupBy(*keys).agg(F.collect_set("_form").alias("_champions")).where(F.size("_champions") > 1)
    return _undominated(left, survivors, keys, clock).drop("_form")


def _undominated(df: DataFrame, champions: DataFrame, keys: tuple[str, ...], clock: str) -> DataFrame:
    none = F.array().cast(champions.schema["_champions"].dataType)
    beaten = F.exists(F.coalesce("_champions", none), lambda c: vclock.happened_before(F.col(clock), F.map_from_entries(c)))
    return df.join(champions, list(keys), "left").where(~beaten).drop("_champions")


def as_of(log: DataFrame, version: int) -> DataFrame:
    """Live entries as they were at a version."""
    return live(log.where(F.col("version") <= version))


def collect_garbage(log: DataFrame, now_ns: int, ttl_ns: int = 24 * 3600 * 10**9) -> DataFrame:
    """Full compaction: winners, without tombstones older than ``ttl_ns``. Safe
    only over all versions of the keys, which is what it is given."""
    old = F.col("tombstone") & (F.lit(now_ns) - F.col("ts_ns") > ttl_ns)
    return winners(log).where(~F.coalesce(old, F.lit(False)))


def merge_order(log: DataFrame) -> DataFrame:
    """All entries as a merge reads them, by key and the newest version first,
    with ``nth``: 1 for the entry that the merge keeps."""
    w = Window.partitionBy("key").orderBy(*version_order(log))
    return log.withColumn("nth", F.row_number().over(w)).orderBy("key", *version_order(log))
