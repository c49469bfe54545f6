"""Exact dedup: frequent digests are decided on the map side, the others meet in a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.text import col, id_text
from lamina.session import materialise

# A digest above this share of all rows is frequent; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE
) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Texts are equal when their bytes are; equality is that of SHA-256 and length.  A
    Misra-Gries summary (``freqItems``) holds every digest above ``hot_share`` of the
    rows and at most ``1 / hot_share`` candidates; a counting pass over the
    candidates alone gives their exact size and largest id, and false ones are dropped.  The
    verified winners are broadcast and decide their rows without a shuffle.  The remaining
    digests are counted before their shuffle, then joined back; no group among them is above ``hot_share``.

    A null text is empty.  Of equal texts the row of the largest id stays; a null id loses against any
    other, and stays if all are null.  Rows that repeat an id and a text are one
    document: all carry the same result.  Other columns are not read.
    """
    if not 0 < hot_share < 1:
        raise ValueError("hot_share must be between 0 and 1")
    digests = materialise(
        id_text(docs, id_col, text_col).select(
            "id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("size")
        ),
        "digests",
    )
    key = ["text_sha256", "size"]
    total = digests.count()
    summary = digests.select("text_sha256").stat.freqItems(["text_sha256"], hot_share)
    candidates = summary.select(F.explode(F.col(summary.columns[0])).alias("text_sha256"))
    group = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = materialise(
        digests.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy(*key).agg(*group)
        .where(F.col("group_size") > hot_share * total),
        "winners",
    )
    frequent = digests.join(F.broadcast(winners), key)
    rest = digests.join(F.broadcast(winners.select(*key)), key, "left_anti")
    ordinary = rest.join(rest.groupBy(*key).agg(*group), key)
    return frequent.unionByName(ordinary).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row has; rows that repeat an id and a text become one."""
    kept = duplicate_groups(docs, id_col, text_col).where("kept").select(
        F.col("id").alias("_id"), F.col("text_sha256").alias("_digest")
    ).distinct()
    digest = F.sha2(F.coalesce(col(text_col), F.lit("")), 256)
    chosen = docs.join(kept, col(id_col).eqNullSafe(F.col("_id")) & (digest == F.col("_digest")))
    return chosen.dropDuplicates(["_id", "_digest"]).drop("_id", "_digest")
