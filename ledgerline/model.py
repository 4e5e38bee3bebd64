"""The data model: versioned entries in an append-only mutation log.

``seq`` (arrival order) and ``node`` (replica) are explicit columns, because a
DataFrame has no order of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_KEY_BYTES = 1024
MAX_VALUE_BYTES = 1 << 20
MAX_BATCH = 10_000

ENTRY = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("version", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("tombstone", T.BooleanType()),
        T.StructField("vclock", T.MapType(T.StringType(), T.LongType())),
        T.StructField("node", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


class KeyNotFound(KeyError):
    """The key is absent or deleted."""


class InvalidEntry(ValueError):
    """A key or value outside the limits."""


class QuorumNotReached(RuntimeError):
    """Fewer replicas answered than asked for."""


def violation(key: Column, value: Column) -> Column:
    """What is wrong with a key and value, or null. Limits are bytes."""
    return (
        F.when(key.isNull() | (key == ""), "empty key")
        .when(F.octet_length(key) > MAX_KEY_BYTES, "key too long")
        .when(F.octet_length(value) > MAX_VALUE_BYTES, "value too large")
    )


def split_valid(df: DataFrame, key: str = "key", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a column ``reason``)."""
    marked = df.withColumn("reason", violation(F.col(key), F.col(value)))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def require_valid(key: str, value: bytes | None = None) -> None:
    size = len(key.encode())
    if not size:
        raise InvalidEntry("empty key")
    if size > MAX_KEY_BYTES:
        raise InvalidEntry("key too long")
    if value is not None and len(value) > MAX_VALUE_BYTES:
        raise InvalidEntry("value too large")


def clip_text(text: Column, width: int = 50) -> Column:
    """A value for display, cut to ``width`` characters with an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def byte_text(n: Column) -> Column:
    """Bytes for display in binary units."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(F.format_number(n / 1024**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out
