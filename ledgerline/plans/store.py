"""A table on disk: an append-only log in epochs and compacted snapshots.

    root/log/epoch=N/        rows appended by batch N
    root/snapshot/upto=N/    the resolved state of all epochs up to N

Readers take the newest complete snapshot and the epochs after it; both are
immutable, so a reader's view never changes under it. Compaction writes a new
snapshot beside the old one; it becomes current when its commit marker is
there. All paths go through Spark and Hadoop, so any file system works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import ENTRY
from ..operators import mutate, resolve
from ..operators.table import KVTable

_DDL = ENTRY


class Store:
    """``ignore_corrupt`` reads past files that can't be read, which else fail."""

    def __init__(self, spark: SparkSession, root: str, ignore_corrupt: bool = False):
        self.spark, self.root, self.ignore_corrupt = spark, root.rstrip("/"), ignore_corrupt

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self, kind: str, name: str) -> list[int]:
        """Numbers of the complete directories root/kind/name=N."""
        jvm = self.spark._jvm
        fs, at = self._fs(f"{self.root}/{kind}")
        if not fs.exists(at):
            return []
        found = []
        for status in fs.listStatus(at):
            path = status.getPath()
            if path.getName().startswith(f"{name}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                found.append(int(path.getName().split("=", 1)[1]))
        return sorted(found)

    def epochs(self) -> list[int]:
        return self._numbers("log", "epoch")

    def snapshots(self) -> list[int]:
        return self._numbers("snapshot", "upto")

    def append(self, rows: DataFrame) -> int:
        """Append a batch of entries as the next epoch; its number."""
        epoch = max([0, *self.epochs(), *self.snapshots()]) + 1
        have = set(rows.columns)
        full = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRY])
        seen = Observation()
        path = f"{self.root}/log/epoch={epoch}"
        full.observe(seen, F.max("version").alias("last")).write.mode("errorifexists").option("compression", "zstd").parquet(path)
        self._note(path, max(seen.get["last"] or 0, self.last_version(epoch)))
        return epoch

    def _note(self, path: str, last: int) -> None:
        fs, at = self._fs(f"{path}/_last_version")
        out = fs.create(at, True)
        out.writeLong(last)
        out.close()

    def last_version(self, before: int | None = None) -> int:
        """The greatest version ever written (before an epoch), noted beside the
        newest epoch or snapshot; where an older writer left no note, the log is
        asked."""
        tops = [(e, f"{self.root}/log/epoch={e}") for e in self.epochs()] + [(s, f"{self.root}/snapshot/upto={s}") for s in self.snapshots()]
        tops = [t for t in tops if before is None or t[0] < before]
        if not tops:
            return 0
        fs, at = self._fs(f"{max(tops)[1]}/_last_version")
        if not fs.exists(at):
            return self.entries().agg(F.max("version")).first()[0] or 0
        inp = fs.open(at)
        last = inp.readLong()
        inp.close()
        return last

    def _read(self, *paths: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("ignoreCorruptFiles", str(self.ignore_corrupt).lower()).parquet(*paths)

    def entries(self, since_epoch: int | None = None) -> DataFrame:
        """Everything a read must see, or the raw epochs after ``since_epoch``."""
        if since_epoch is not None:
            return self._read(*[f"{self.root}/log/epoch={e}" for e in self.epochs() if e > since_epoch])
        snap = max(self.snapshots(), default=0)
        paths = [f"{self.root}/snapshot/upto={snap}"] if snap else []
        return self._read(*paths, *[f"{self.root}/log/epoch={e}" for e in self.epochs() if e > snap])

    def table(self, rule: str = "version") -> KVTable:
        return KVTable(self.entries(), rule)

    def compact(self, now_ns: int, ttl_ns: int = 24 * 3600 * 10**9) -> int:
        """Resolve everything into a new snapshot, sorted by key for pruning and
        with a bloom filter for point reads. Old tombstones go: the merge sees
        all versions of a key, so none can come back."""
        upto = max(self.epochs(), default=0)
        if not upto or upto in self.snapshots():
            return upto
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        state = resolve.collect_garbage(self.entries(), now_ns, ttl_ns)
        out = state.repartitionByRange(parts, "key").sortWithinPartitions("key").write.option("compression", "zstd")
        out = out.option("parquet.bloom.filter.enabled#key", "true")
        last, path = self.last_version(), f"{self.root}/snapshot/upto={upto}"
        out.mode("errorifexists").parquet(path)
        self._note(path, last)
        return upto

    def truncate(self) -> int:
        """Delete epochs and snapshots that the newest snapshot replaces."""
        snap = max(self.snapshots(), default=0)
        gone = [f"log/epoch={e}" for e in self.epochs() if e <= snap] + [f"snapshot/upto={s}" for s in self.snapshots() if s < snap]
        for name in gone:
            fs, at = self._fs(f"{self.root}/{name}")
            fs.delete(at, True)
        return len(gone)

    def size(self) -> int:
        """Bytes on disk that a read may touch."""
        snap = max(self.snapshots(), default=0)
        names = ([f"snapshot/upto={snap}"] if snap else []) + [f"log/epoch={e}" for e in self.epochs() if e > snap]
        return sum(fs.getContentSummary(at).getLength() for fs, at in (self._fs(f"{self.root}/{n}") for n in names))

    def reset(self) -> None:
        """Forget everything: log and snapshots are deleted."""
        for kind in ("log", "snapshot"):
            fs, at = self._fs(f"{self.root}/{kind}")
            fs.delete(at, True)

    def put(self, key: str, value: bytes, node: str, now_ns: int, clock: dict[str, int] | None = None) -> int:
        return self.append(mutate.put(self.entries(), key, value, node, now_ns, clock, self.last_version()))

    def delete(self, key: str, node: str, now_ns: int, strict: bool = False) -> int:
        keys = self.spark.createDataFrame([(key,)], "key string")
        return self.append(mutate.delete(self.entries(), keys, node, now_ns, strict, self.last_version())[0])

    def stats(self) -> DataFrame:
        """level (log or snapshot), files, entries, bytes of keys and values."""
        size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")
        level = F.when(F.input_file_name().contains("/snapshot/"), "snapshot").otherwise("log")
        rows = self.entries().select(level.alias("level"), F.input_file_name().alias("_file"), size.alias("_size"))
        return rows.groupBy("level").agg(F.countDistinct("_file").alias("files"), F.count("*").alias("entries"), F.sum("_size").alias("bytes"))
