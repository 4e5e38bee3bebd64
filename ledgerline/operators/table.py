"""Reads of a key-value table over a mutation log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MAX_BATCH, InvalidEntry, KeyNotFound
from . import resolve

#: Requested keys are broadcast only if the caller's list is this short.
BROADCAST_KEYS = 100_000


def next_prefix(prefix: str) -> str | None:
    """The least string above every string with ``prefix``, by code points."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i])
        if c < 0x10FFFF:
            c = 0xE000 if c == 0xD7FF else c + 1
            return prefix[:i] + chr(c)
    return None


def with_prefix(df: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Rows whose key starts with ``prefix``, with bounds that scans can prune by."""
    if not prefix:
        return df
    out = df.where(F.col(key).startswith(prefix) & (F.col(key) >= prefix))
    above = next_prefix(prefix)
    return out if above is None else out.where(F.col(key) < above)


class KVTable:
    """One table: a DataFrame of entries, and the rule by which entries win."""

    def __init__(self, log: DataFrame, rule: str = "version"):
        self.log, self.rule = log, rule

    def scan(self, prefix: str = "", start_after: str | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
        """Live entries in key order. A limit plans as a top-k, not a full sort."""
        log = with_prefix(self.log, prefix)
        if start_after is not None:
            log = log.where(F.col("key") < start_after if reverse else F.col("key") > start_after)
        out = resolve.live(log, self.rule).orderBy(F.desc("key") if reverse else F.asc("key"))
        return out if limit is None else out.limit(limit)

    def raw_scan(self, prefix: str = "") -> DataFrame:
        """Every entry of a prefix as it was written, superseded ones and
        tombstones too."""
        return with_prefix(self.log, prefix)

    def overlay(self, rows: DataFrame) -> KVTable:
        """This table with unlogged writes on top: they are read like others, but
        live only as long as the relation."""
        return KVTable(self.log.unionByName(rows, allowMissingColumns=True), self.rule)

    def keys(self, prefix: str = "") -> DataFrame:
        return self.scan(prefix).select("key")

    def glob(self, pattern: str) -> DataFrame:
        """Live entries whose key matches a pattern of ``*`` and ``?``. The part
        before the first of them is pushed down as a prefix."""
        wild = min([i for i in map(pattern.find, "*?") if i >= 0], default=len(pattern))
        own = with_prefix(self.log, pattern[:wild])
        like = "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in pattern)
        return resolve.live(own.where(F.col("key").like(like)), self.rule).orderBy("key")

    def get(self, key: str) -> DataFrame:
        return resolve.live(self.log.where(F.col("key") == key), self.rule)

    def fetch(self, key: str):
        """The live entry as a Row; KeyNotFound if there is none."""
        row = self.get(key).first()
        if row is None:
            raise KeyNotFound(key)
        return row

    def multi_get(self, wanted: list[str] | DataFrame) -> DataFrame:
        """pos, key, found and the entry of each requested key, in request order."""
        if isinstance(wanted, list):
            if len(wanted) > MAX_BATCH:
                raise InvalidEntry(f"more than {MAX_BATCH} keys")
            wanted = self.log.sparkSession.createDataFrame(list(enumerate(wanted)), "pos long, key string")
            log = self.log.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi")
        else:
            log = self.log.join(wanted.select("key").distinct(), "key", "left_semi")
        state = resolve.live(log, self.rule)
        rest = [c for c in state.columns if c != "key"]
        return wanted.join(state, "key", "left").select("pos", "key", F.col("tombstone").isNotNull().alias("found"), *rest)

    def exists(self, wanted: list[str] | DataFrame) -> DataFrame:
        return self.multi_get(wanted).select("pos", "key", "found")

    def seek(self, key: str) -> DataFrame:
        """The first live entry at or after ``key``."""
        return resolve.live(self.log.where(F.col("key") >= key), self.rule).orderBy("key").limit(1)

    def first(self) -> DataFrame:
        return self.scan(limit=1)

    def last(self) -> DataFrame:
        return self.scan(limit=1, reverse=True)

    def cursor(self, prefix: str = "") -> Iterator:
        """Live entries one by one, a partition at a time on the driver."""
        return self.scan(prefix).toLocalIterator()

    def neighbours(self, prefix: str = "") -> DataFrame:
        """key, before, after: a cursor's steps from each key. Keys are ranked by
        ranges and joined by rank, as a window over all keys would be one task."""
        from .merkle import global_rank

        own = global_rank(self.log_keys(prefix))
        before = own.select((F.col("rank") + 1).alias("rank"), F.col("key").alias("before"))
        after = own.select((F.col("rank") - 1).alias("rank"), F.col("key").alias("after"))
        return own.join(before, "rank", "left").join(after, "rank", "left").select("key", "before", "after")

    def log_keys(self, prefix: str = "") -> DataFrame:
        return resolve.live(with_prefix(self.log, prefix), self.rule).select("key")

    def positions(self, prefix: str = "") -> DataFrame:
        """key, pos, total, has_next: where a cursor stands at each live key."""
        from .merkle import global_rank

        own = global_rank(self.log_keys(prefix), name="pos")
        total = own.count()
        return own.select("key", "pos", F.lit(total).cast("long").alias("total"), (F.col("pos") + 1 < total).alias("has_next"))

    def pages(self, size: int, prefix: str = "") -> Iterator[list]:
        """Lists of at most ``size`` entries by keyset pagination."""
        after = None
        while rows := self.scan(prefix, start_after=after, limit=size).collect():
            yield rows
            after = rows[-1].key

    def changes_since(self, version: int) -> DataFrame:
        return self.log.where(F.col("version") > version)

    def tombstones(self) -> DataFrame:
        return resolve.winners(self.log, self.rule).where("tombstone")

    def stats(self) -> DataFrame:
        """One row: entries, live_keys, tombstones, live_bytes, max_version."""
        entries = self.log.agg(F.count("*").alias("entries"), F.max("version").alias("max_version"))
        alive = ~F.coalesce(F.col("tombstone"), F.lit(False))
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
        state = resolve.winners(self.log, self.rule).agg(
            F.count_if(alive).alias("live_keys"), F.count_if(~alive).alias("tombstones"), F.coalesce(F.sum(F.when(alive, size.cast("long"))), F.lit(0)).alias("live_bytes")
        )
        return entries.crossJoin(state)  # one row each

    def versions_per_key(self) -> DataFrame:
        return self.log.groupBy("key").agg(F.count("*").alias("n_versions"), F.count_if("tombstone").alias("n_tombstones"), F.min("version").alias("min_version"), F.max("version").alias("max_version"))

    def bytes_by(self, *columns: str) -> DataFrame:
        """Entries and bytes of the log by any columns (levels, files, nodes)."""
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
        return self.log.groupBy(*columns).agg(F.count("*").alias("entries"), F.sum(size.cast("long")).alias("bytes"))
