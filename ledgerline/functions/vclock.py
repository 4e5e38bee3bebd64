"""Vector clocks as map<string, bigint> columns; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, AFTER, CONCURRENT = "BEFORE", "AFTER", "CONCURRENT"


def empty() -> Column:
    return F.create_map().cast("map<string,bigint>")


def increment(clock: Column, node: Column | str) -> Column:
    node = F.lit(node) if isinstance(node, str) else node
    clock = F.coalesce(clock, empty())
    rest = F.map_filter(clock, lambda k, _: k != node)
    return F.map_concat(rest, F.create_map(node, F.coalesce(F.element_at(clock, node), F.lit(0)) + F.lit(1).cast("bigint")))


def merge(a: Column, b: Column) -> Column:
    """Pointwise maximum; a missing node counts as zero, null as empty."""
    return F.map_zip_with(F.coalesce(a, empty()), F.coalesce(b, empty()), lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def _any(a: Column, b: Column, test) -> Column:
    gaps = F.map_zip_with(F.coalesce(a, empty()), F.coalesce(b, empty()), lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.exists(F.map_values(gaps), test)


def happened_before(a: Column, b: Column) -> Column:
    """True if a is strictly dominated by b."""
    return _any(a, b, lambda d: d < 0) & ~_any(a, b, lambda d: d > 0)


def compare(a: Column, b: Column) -> Column:
    """BEFORE, AFTER or CONCURRENT of a relative to b; equal clocks are AFTER."""
    less, more = _any(a, b, lambda d: d < 0), _any(a, b, lambda d: d > 0)
    return F.when(less & more, CONCURRENT).when(less, BEFORE).otherwise(AFTER)


def is_zero(clock: Column) -> Column:
    return F.coalesce(F.size(F.map_filter(clock, lambda _, v: v != 0)), F.lit(0)) <= 0
