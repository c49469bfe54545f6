"""Train/test splits and folds; every assignment is a function of the row key and a seed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.hashing import HASH_BITS, key_hash
from lamina.plans.cuts import BUCKET_ROWS, hash_cuts
from lamina.plans.lookup import lookup_join
from lamina.plans.ranks import key_literals, keys_at_ranks, nulls_first, order_key
from lamina.plans.row_index import with_row_index
from lamina.session import BROADCAST_ROWS

# Block starts that are looked up and compared per row.
MAX_EDGES = 200
# Leading bits of a hash that rows are counted by at most.
MOST_BITS = 16


def row_key(*columns: str, df: DataFrame | None = None) -> Column:
    """The columns' texts joined by ``|``; a mark inside a text and a null are escaped, so different keys differ.

    Whole numbers, which ``df`` tells, have no marks and are not searched for them.
    """
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)} if df is not None else set()
    texts = [
        F.col(c).cast("string") if c in whole
        else F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        for c in columns
    ]
    return F.concat_ws("|", *[F.coalesce(t, F.lit("\\N")) for t in texts])


def _test_rows(test_size: float | int):
    """Rows in the test part: a share is rounded up, an integer is taken as it is."""
    return lambda n: test_size if isinstance(test_size, int) else math.ceil(n * test_size)


def train_test_split(df: DataFrame, keys: Sequence[str], test_size: float | int = 0.25, seed: int = 0) -> DataFrame:
    """Add ``split``: exactly ceil(n * test_size) rows are ``test``, the ones with the smallest hash.

    ``keys`` must identify a row.  The cut comes from hash histograms; rows are not moved.
    """
    key = row_key(*keys, df=df)
    cuts, _ = hash_cuts(df, {0: key_hash(seed, key)}, key, _test_rows(test_size))
    return df.withColumn("split", F.when(cuts[0], F.lit("test")).otherwise(F.lit("train")))


def shuffle_split(
    df: DataFrame, keys: Sequence[str], n_splits: int = 10, test_size: float | int = 0.1, seed: int = 0
) -> DataFrame:
    """Each row once per split, with ``split_no`` and its ``role``; the splits are independent draws."""
    key = row_key(*keys, df=df)
    hashes = {s: key_hash(seed, s, key) for s in range(n_splits)}
    cuts, _ = hash_cuts(df, hashes, key, _test_rows(test_size))
    roles = F.array(
        *[
            F.struct(F.lit(s).alias("split_no"), F.when(cuts[s], F.lit("test")).otherwise(F.lit("train")).alias("role"))
            for s in range(n_splits)
        ]
    )
    return df.select("*", F.explode(roles).alias("_r")).select(*df.columns, "_r.split_no", "_r.role")


def _blocks(df: DataFrame, order: Sequence[str], starts: Sequence[int], total: int) -> tuple[Column, list[Column | None]]:
    """The order key and the key at the start of every block; None past the end."""
    key = order_key(df, order)
    found = keys_at_ranks(df, key, starts, total)
    literal = key_literals(df, key)
    return key, [literal(found[s]) if s in found else None for s in starts]


def kfold(
    df: DataFrame, order: Sequence[str], n_splits: int = 5, shuffle: bool = False, seed: int = 0
) -> DataFrame:
    """Add ``fold``: contiguous blocks of rows in ``order``, the first n mod k one row longer.

    ``order`` must identify a row.  Only the keys at the k - 1 block starts are looked up; the
    rows get their fold by comparison and stay where they are.
    """
    if n_splits < 2:
        raise ValueError("at least two folds are needed")
    total = df.count()
    base, longer = divmod(total, n_splits)
    starts = [b * base + min(b, longer) for b in range(1, n_splits)]
    if shuffle:
        return _shuffled_blocks(df, order, seed, starts, total)
    key, edges = _blocks(df, order, starts, total)
    fold = F.lit(0)
    for edge in edges:
        if edge is not None:
            fold = fold + F.when(key >= edge, F.lit(1)).otherwise(F.lit(0))
    return df.select("*", fold.cast("int").alias("fold"))


def _shuffled_blocks(df: DataFrame, order: Sequence[str], seed: int, starts: Sequence[int], total: int) -> DataFrame:
    """``fold`` by the order of a hash, then of the keys; the hash is made once for the lookups and settles nearly every comparison."""
    hashes = df.withColumn("_hash", key_hash(seed, row_key(*order, df=df)))
    found = _hashed_keys(hashes, ["_hash", *order], starts, total)
    key, literal = order_key(df, order), key_literals(df, order_key(df, order))
    fold = F.lit(0)
    for start in starts:
        if start in found:
            edge, *rest = found[start]
            after = F.when(F.col("_hash") == F.lit(edge), key >= literal(rest)).otherwise(F.col("_hash") > F.lit(edge))
            fold = fold + F.when(after, F.lit(1)).otherwise(F.lit(0))
    return hashes.select(*df.columns, fold.cast("int").alias("fold"))


def _hashed_keys(df: DataFrame, order: Sequence[str], ranks: Sequence[int], total: int, bucket_rows: int = BUCKET_ROWS) -> dict[int, tuple]:
    """As :func:`keys_at_ranks` where the first column of ``order`` is an even hash: its leading bits are counted, then only the buckets with a rank are sorted."""
    key = order_key(df, order)
    bucket = F.shiftright(order[0], HASH_BITS - min(MOST_BITS, (2 * total // bucket_rows).bit_length()))
    counts = df.groupBy(bucket.alias("bucket")).count().orderBy("bucket").collect()
    places, below = {}, 0
    for r in counts:
        for rank in ranks:
            if below <= rank < below + r["count"]:
                places.setdefault((r["bucket"], rank - below), []).append(rank)
        below += r["count"]
    wanted = {b for b, _ in places}
    if any(r["count"] > bucket_rows for r in counts if r["bucket"] in wanted):
        return keys_at_ranks(df, key, ranks, total)
    inside = df.select(bucket.alias("bucket"), key.alias("k")).where(F.col("bucket").isin(sorted(wanted)))
    at = (F.row_number().over(Window.partitionBy("bucket").orderBy("k")) - 1).alias("at")
    chosen = [(F.col("bucket") == b) & (F.col("at") == a) for b, a in places]
    found = inside.select("*", at).where(reduce(Column.__or__, chosen, F.lit(False))).collect()
    return {rank: tuple(r["k"]) for r in found for rank in places[r["bucket"], r["at"]]}


def stratified_kfold(
    df: DataFrame, label: str, order: Sequence[str], n_splits: int = 5, max_edges: int = MAX_EDGES
) -> DataFrame:
    """Add ``fold`` so that every class is spread evenly, in contiguous runs within the class.

    Classes are laid end to end in order of first appearance; position p of that line
    belongs to fold p mod k, which fixes how many rows of a class each fold gets.  Within
    the class the first rows go to fold 0, and so on.  The runs' first keys are looked up as
    in :func:`kfold`; with too many classes for that, rows are numbered by class instead.
    """
    first = F.min(order_key(df, order)).alias("_first")
    classes = df.groupBy(F.col(label).alias("_class")).agg(first, F.count(F.lit(1)).alias("_size"))
    listed = classes.orderBy("_class").limit(max_edges // (n_splits - 1) + 1).collect()
    if len(listed) * (n_splits - 1) > max_edges:
        return _stratified_by_rank(df, label, order, n_splits)
    by_first = sorted(listed, key=lambda r: nulls_first(r["_first"]))
    shares, start = {}, 0
    for r in by_first:
        end = start + r["_size"]
        shares[r["_class"]] = [-(-(end - f) // n_splits) - -(-(start - f) // n_splits) for f in range(n_splits)]
        start = end
    # Global ranks in the order (class, row) at which each fold's run starts.
    starts, begin = [], 0
    for r in listed:
        at = begin
        for share in shares[r["_class"]][:-1]:
            at += share
            starts.append(at)
        begin += r["_size"]
    key, edges = _blocks(df, [label, *order], starts, begin)
    fold = F.lit(0)
    for i, r in enumerate(listed):
        own = F.col(label).eqNullSafe(F.lit(r["_class"]))
        inner = F.lit(0)
        for edge in edges[i * (n_splits - 1):(i + 1) * (n_splits - 1)]:
            if edge is not None:
                inner = inner + F.when(key >= edge, F.lit(1)).otherwise(F.lit(0))
        fold = F.when(own, inner).otherwise(fold)
    return df.withColumn("fold", fold.cast("int"))


def _stratified_by_rank(df: DataFrame, label: str, order: Sequence[str], n_splits: int) -> DataFrame:
    """The same folds from global row numbers, for any number of classes."""
    by_class, _ = with_row_index(df, [F.col(label), *map(F.col, order)], "_line")
    classes = by_class.groupBy(F.col(label).alias("_class")).agg(
        F.min(order_key(df, order)).alias("_first"), F.min("_line").alias("_from"), F.count(F.lit(1)).alias("_size")
    )
    laid = with_row_index(classes, ["_first"], "_nth").frame
    chunk = F.floor(F.col("_nth") / F.lit(BROADCAST_ROWS))
    # Sizes of earlier classes: inside a chunk by a window, before it by the chunks' sums.
    sums = laid.groupBy(chunk.alias("_chunk")).agg(F.sum("_size").alias("_sum"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_chunk").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("_chunk", chunk).join(sums, "_chunk").withColumn(
        "_start", F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    )

    def upto(position: Column, f: Column) -> Column:
        return F.ceil((position - f) / F.lit(n_splits)).cast("bigint")

    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    shares = F.transform(folds, lambda f: upto(F.col("_start") + F.col("_size"), f) - upto(F.col("_start"), f))
    known = laid.select("_class", "_from", shares.alias("_shares"), "_size")
    joined = lookup_join(by_class.withColumn("_class", F.col(label)), known, "_class", "_size")
    rank = F.col("_line") - F.col("_from")
    ends = F.transform(
        folds, lambda f: F.aggregate(F.slice("_shares", F.lit(1), f + 1), F.lit(0).cast("bigint"), lambda a, s: a + s)
    )
    return joined.select(*df.columns, F.size(F.filter(ends, lambda end: end <= rank)).cast("int").alias("fold"))


def time_series_split(df: DataFrame, order: Sequence[str], n_splits: int = 5) -> DataFrame:
    """Each row once per split it takes part in, with ``split_no`` and ``role``.

    The last n_splits blocks of n // (n_splits + 1) rows are the test blocks; everything
    before a block is its training part.  ``order`` must identify a row.
    """
    total = df.count()
    size = total // (n_splits + 1)
    if size < 1:
        raise ValueError("too few rows for the number of splits")
    starts = [total - (n_splits - s) * size for s in range(n_splits)]
    key, edges = _blocks(df, order, starts, total)
    roles = []
    for s in range(n_splits):
        test = key < edges[s + 1] if s + 1 < n_splits else F.lit(True)
        role = F.when(key < edges[s], F.lit("train")).when(test, F.lit("test"))
        roles.append(F.struct(F.lit(s).alias("split_no"), role.alias("role")))
    return (
        df.select("*", F.explode(F.filter(F.array(*roles), lambda r: r["role"].isNotNull())).alias("_r"))
        .select(*df.columns, "_r.split_no", "_r.role")
    )


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    return with_row_index(df, order, name).frame


def head_rows(df: DataFrame, order: Sequence[str], n: int = 1000) -> DataFrame:
    """The first n rows in ``order``, a bounded sort per task."""
    return df.orderBy(*order).limit(n)
