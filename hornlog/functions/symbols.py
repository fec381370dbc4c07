"""The 64-bit id of a text: the first eight bytes of its SHA-256, big-endian, sign bit cleared."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_id(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") & 0x7FFFFFFFFFFFFFFF


def symbol_id_column(text: Column) -> Column:
    """The same as a column, in the JVM: the low 63 bits in two parts, so that nothing overflows."""
    digest = F.sha2(text, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return high * F.lit(1 << 32) + low
