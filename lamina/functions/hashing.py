"""Seeded uniform numbers derived from row keys, so that any re-run gives the same draw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits = 52 bits: every value is exact in a double.
HEX_DIGITS = 13
HASH_BITS = 4 * HEX_DIGITS
HASH_RANGE = 1 << HASH_BITS


def key_hash(*parts: Column | str | int) -> Column:
    """52-bit integer from MD5 of the parts joined by ``|``; portable to other SQL engines."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Double in [0, 1)."""
    return key_hash(*parts) / F.lit(float(HASH_RANGE))
