"""Writes: every mutation is rows to append to the log.

Versions are stamped from one clock: the greatest version so far plus the
position in the batch, so a later write always beats an earlier one. A store
knows that version (``Store.last_version``) and passes it as ``base``; a bare
log is asked for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vclock
from ..model import MAX_BATCH, InvalidEntry, split_valid
from . import resolve


def _complete(batch: DataFrame, node: str, now_ns: int) -> DataFrame:
    """Fill what an entry lacks, leaving what the caller gave."""
    have = batch.columns
    or_own = lambda c, own: F.coalesce(F.col(c), own) if c in have else own
    return batch.withColumns(
        {
            "ts_ns": or_own("ts_ns", F.lit(now_ns).cast("long")),
            "tombstone": or_own("tombstone", F.lit(False)),
            "node": or_own("node", F.lit(node)),
            "vclock": or_own("vclock", F.create_map(F.lit(node), F.lit(1).cast("bigint"))),
        }
    )


def latest_version(log: DataFrame) -> int:
    return log.agg(F.max("version")).first()[0] or 0


def batch_put(log: DataFrame, batch: DataFrame, node: str, now_ns: int, order: str | Column = "pos", base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows). ``order`` is the position in the batch;
    of a key's several rows the last position wins. Versions that the batch
    gives are kept."""
    good, bad = split_valid(batch)
    col = F.col(order) if isinstance(order, str) else order
    last = good.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(col)))).where("_r = 1").drop("_r")
    base = latest_version(log) if base is None else base
    stamp = F.lit(base) + 1 + col.cast("long")
    version = F.coalesce(F.col("version"), stamp) if "version" in batch.columns else stamp
    return _complete(last.withColumn("version", version).withColumn("seq", stamp), node, now_ns), bad


def request_batch(log: DataFrame, batch: DataFrame, node: str, now_ns: int, order: str | Column = "pos", base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one row: applied, errors) of a request of at most
    MAX_BATCH entries, which is taken whole or not at all: with an entry that
    breaks the limits nothing is applied and all count as errors."""
    n = batch.limit(MAX_BATCH + 1).count()
    if n > MAX_BATCH:
        raise InvalidEntry(f"more than {MAX_BATCH} entries")
    rows, bad = batch_put(log, batch, node, now_ns, order, base)
    spoilt = bool(bad.take(1))
    answer = log.sparkSession.createDataFrame([(0 if spoilt else n, n if spoilt else 0)], "applied long, errors long")
    return (rows.limit(0) if spoilt else rows), answer


def put(log: DataFrame, key: str, value: bytes, node: str, now_ns: int, clock: dict[str, int] | None = None, base: int | None = None) -> DataFrame:
    spark = log.sparkSession
    row = spark.createDataFrame([(0, key, bytearray(value), clock)], "pos long, key string, value binary, vclock map<string,bigint>")
    rows, bad = batch_put(log, row, node, now_ns, base=base)
    if reason := bad.select("reason").first():
        raise InvalidEntry(reason[0])
    return rows.drop("pos")


def delete(log: DataFrame, keys: DataFrame, node: str, now_ns: int, strict: bool = False, base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tombstones to append, keys that weren't there). Idempotent by default:
    unknown keys get a tombstone too; with ``strict`` they don't."""
    state = resolve.live(log.join(keys.select("key").distinct(), "key", "left_semi")).select("key")
    missing = keys.join(state, "key", "left_anti")
    hit = keys.join(state, "key", "left_semi") if strict else keys
    base = latest_version(log) if base is None else base
    one = hit.select("key").distinct()
    rows = one.withColumns({"value": F.lit(None).cast("binary"), "version": F.lit(base + 1).cast("long"), "seq": F.lit(base + 1).cast("long"), "tombstone": F.lit(True)})
    return _complete(rows, node, now_ns), missing


def advance_clocks(log: DataFrame, rows: DataFrame, node: str) -> DataFrame:
    """``rows`` with the clock of their key's winner in ``log``, one write of
    ``node`` further: what a coordinator sends."""
    known = resolve.winners(log.join(rows.select("key").distinct(), "key", "left_semi")).select("key", F.col("vclock").alias("_known"))
    return rows.join(known, "key", "left").withColumn("vclock", vclock.increment(F.col("_known"), node)).drop("_known")


def read_modify_write(log: DataFrame, keys: DataFrame, change, node: str, now_ns: int, base: int | None = None) -> DataFrame:
    """Rows to append: ``change(value)`` of each requested live key, one version
    above the log, clocks advanced from the current winner."""
    base = latest_version(log) if base is None else base
    state = resolve.live(log.join(keys.select("key").distinct(), "key", "left_semi"))
    out = state.withColumns({"value": change(F.col("value")), "version": F.lit(base + 1).cast("long"), "ts_ns": F.lit(now_ns).cast("long"), "node": F.lit(node), "seq": F.lit(base + 1).cast("long")})
    return out.withColumn("vclock", vclock.increment(F.col("vclock"), node)) if "vclock" in log.columns else out


def coalesce_writes(batch: DataFrame, order: str = "seq") -> DataFrame:
    """A write buffer's effect: the last write of each key."""
    return batch.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(order)))).where("_r = 1").drop("_r")
