"""Hashes: CRC-32 ring positions, and a 64-bit scramble that needs wraparound."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_SIZE = 1 << 32
# Fixed values of the public FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def ring_position(key: Column) -> Column:
    """CRC-32 (IEEE) of the key's UTF-8 bytes, 0 to 2^32 - 1."""
    return F.crc32(key.cast("binary"))


def ring_position_of(text: str) -> int:
    return zlib.crc32(text.encode())


def scramble64(value: Column) -> Column:
    """FNV-1a of the eight bytes of a long, lowest first, as a non-negative
    long. An Arrow UDF: multiplication must wrap, which ANSI arithmetic forbids."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("long")
    def fnv(v):
        import numpy as np
        import pyarrow as pa

        x = v.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        h = np.full(len(x), FNV_OFFSET, np.uint64)
        for i in range(8):
            h = (h ^ ((x >> np.uint64(8 * i)) & np.uint64(255))) * np.uint64(FNV_PRIME)
        return pa.array((h & np.uint64(2**63 - 1)).astype(np.int64))

    return fnv(value)
