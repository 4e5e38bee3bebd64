"""The four percentile rules by name, over groups of any size.

Every rule picks one element of the sorted group by an index that depends on
the group's size n and on p. The elements are found by ranges of values, so that
one group with most of the rows is spread over tasks like many small ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written


def ycsb_index(n: Column, p: float) -> Column:
    """int(n * p), at most the last."""
    return F.least(n - 1, F.floor(n * F.lit(p)))


def phase_index(n: Column, p: float) -> Column:
    """int((n - 1) * p)."""
    return F.floor((n - 1) * F.lit(p))


def nearest_rank_index(n: Column, p: float) -> Column:
    """ceil(n * p) - 1, clamped to the group."""
    return F.greatest(F.lit(0), F.least(n - 1, F.ceil(n * F.lit(p)) - 1))


RULES = {"ycsb": ycsb_index, "phase": phase_index, "nearest_rank": nearest_rank_index}


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def at_ranks(df: DataFrame, keys: list[str], value: str, indexes: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row for each group: n, and under each name the value at the index
    (from 0) that its function makes of n. No group is sorted in one task:
    distinct values with counts are dealt by ranges of (group, value) and
    written, the ranges' totals tell which range holds an index, and only
    those are ranked, each by itself."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    own = [f"_k{i}" for i in range(len(keys))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*named, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = written(counts.repartitionByRange(parts, *own, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*own, "_part").agg(F.sum("_c").alias("_s"))  # groups and ranges
    w = Window.partitionBy(*own)
    sums = sums.withColumns({"_n": F.sum("_s").over(w), "_before": F.coalesce(F.sum("_s").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    wanted = F.posexplode(F.array(*[f(F.col("_n")).cast("long") for f in indexes.values()])).alias("_which", "_index")
    hits = sums.select(*own, "_part", "_n", "_before", "_s", wanted).where((F.col("_index") >= F.col("_before")) & (F.col("_index") < F.col("_before") + F.col("_s")))
    inside = ranged.alias("r").join(hits.drop("_s").alias("h"), (F.col("r._part") == F.col("h._part")) & _same("r", "h", own))
    inside = inside.select(*[F.col(f"r.{c}").alias(c) for c in own], "_v", "_c", "r._part", "_which", "_index", "_n", "_before")
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_part", *own, "_which").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).where((F.col("_upto") > F.col("_index")) & (F.col("_upto") - F.col("_c") <= F.col("_index")))
    pick = [F.max(F.when(F.col("_which") == j, F.col("_v"))).alias(name) for j, name in enumerate(indexes)]
    out = found.groupBy(*own).agg(F.max("_n").alias("n"), *pick)
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], "n", *indexes)


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], rule: str) -> DataFrame:
    """One row for each group: n, then one column for each name in ``ps``."""
    index = RULES[rule]
    return at_ranks(df, keys, value, {name: (lambda n, p=p: index(n, p)) for name, p in ps.items()})


def histogram_percentile(df: DataFrame, keys: list[str], value: str, width: float, p: float) -> DataFrame:
    """The first bucket (its number) whose cumulative count reaches int(n * p)."""
    own = df.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(value) / width))
    return at_ranks(own, keys, "_b", {"bucket": lambda n: F.greatest(F.floor(n * F.lit(p)), F.lit(1)) - 1})
