"""Left join to a dictionary with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import BROADCAST_ROWS

BROADCAST_BYTES = 32 << 20
# A key above this share of all rows is joined by broadcast, the others by shuffle.
HOT_SHARE = 0.001


def lookup_join(
    df: DataFrame, dictionary: DataFrame, key: str, count: str,
    broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` left-joined to ``dictionary`` on ``key``; ``count`` (rows per key) is dropped.

    A dictionary within the bounds is broadcast.  Beyond them, the few keys that are hot
    (at most 1 / HOT_SHARE) are broadcast and everything else meets in a shuffle that
    then has no heavy key.  Null keys never reach the shuffle.
    """
    size = dictionary.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(count), F.lit(0)).alias("total"),
    ).first()
    if size["rows"] <= broadcast_rows and size["bytes"] <= broadcast_bytes:
        return df.join(F.broadcast(dictionary.drop(count)), key, "left")
    hot = dictionary.filter(F.col(count) > size["total"] * HOT_SHARE)
    hot_keys = [r[0] for r in hot.select(key).collect()]
    is_hot = F.col(key).isNull() | F.coalesce(F.col(key).isin(hot_keys), F.lit(False))
    heavy = df.filter(is_hot).join(F.broadcast(hot.drop(count)), key, "left")
    rest = df.filter(~is_hot).join(dictionary.drop(count), key, "left")
    return heavy.unionByName(rest)
