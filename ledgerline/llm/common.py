"""Shared pieces of the training-data operators: tables, lineage cuts, lexing.

Words everywhere in this subpackage are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]`` unless an operator says otherwise.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none and all of Spark runs in one process
    (tests) a temporary folder is made, one for the application;
    on a cluster a missing setting is an error.
    """
    key = "spark.checkpoint.dir"
    place = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {key} to a folder that all executors share")
        own = spark.sparkContext.applicationId
        place = _own[own] = _own.get(own) or "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    return place.rstrip("/")


#: Lists that note the tables written by cut(); innermost last.
_noted: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _noted[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def noting() -> Iterator[list[str]]:
    """The paths that cut() writes inside the block."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def named(*columns: str) -> list[Column]:
    """Columns by their whole names, whatever signs those hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def fresh(columns: list[str], name: str) -> str:
    """``name``, or if a column has it, the first of ``name_``, ``name__``..."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Lexed:
    """Words of a run of texts, laid out for numpy.

    ``norm`` holds every word followed by one space; word ``i`` is
    ``norm[start[i]:end[i]]``; text ``t`` owns words ``first[t]:first[t + 1]``.
    """

    __slots__ = ("end", "first", "norm", "start")

    def __init__(self, texts: list[bytes], lower_ascii: bool = False):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        keep = ~space
        keep[end] = True
        norm = raw[keep]
        length = end - start
        self.start = np.concatenate((np.zeros(1, np.int64), np.cumsum(length + 1)))[:-1]
        self.end = self.start + length
        norm[self.end] = 32
        if lower_ascii:
            norm += ((norm >= 65) & (norm <= 90)).astype(np.uint8) * np.uint8(32)
        self.norm = norm
        at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.first = np.concatenate((np.zeros(1, np.int64), np.searchsorted(start, at)))

    def __len__(self) -> int:
        return len(self.start)


def runs_by_size(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about ``limit`` bytes; one text is never split."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A binary or string column as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Give memory that a task no longer uses back to the system: the worker
    lives on beside the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def then_released(fn):
    """``fn`` over batches, and release() when they have all been read."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


#: Bytes of a batch that are made into Python objects at a time.
SLICE = 1 << 21


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in order, in views of about ``limit`` bytes; a row is never split."""
    for b in batches:
        step = max(1, b.num_rows * limit // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def map_batches(df: DataFrame, fn, schema: str, limit: int | None = None) -> DataFrame:
    """``fn(batch) -> pa.RecordBatch | None`` over Arrow batches, or with a
    ``limit`` over slices of them."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit) if limit else batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(then_released(each), schema)
