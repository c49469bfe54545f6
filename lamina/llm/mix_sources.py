"""Mixing sources to target weights: cube-method balanced sampling in a stream of bounded buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.text import col
from lamina.plans.lookup import lookup_join
from lamina.plans.row_index import with_row_index
from lamina.session import materialise

# The weights of the sources in code point order, repeating, and the most a source is repeated.
WEIGHTS = (5, 2, 1)
MOST = 3
# Documents of a source that one flight goes over; what it leaves open goes into the next flight.
FLIGHT_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"
SETTLED = 1e-9
# Some documents of a source's last flight, the largest and ever smaller ones, wait for the landing, which looks at
# all subsets of what is left (at most two more) and draws one of the few nearest to the totals.
LANDING_RESERVE = 12
LANDING_CHOICES = 4


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, n_docs, target)`` for each source of ``(source, size)``.

    All sizes are shared out by weight; a source stops at ``most`` times its own size and the excess
    goes to the others by weight, until none is above.  One pass over the sources for
    each round; the driver only sees the totals.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = with_row_index(
        totals.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank"
    ).frame
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", "n_docs", weight.alias("weight")), "sources")
    limit = F.col("source_size") * float(most)
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0]
    share, stopped = 0.0, -1
    while True:
        above = limit <= F.col("weight") * share if stopped >= 0 else F.lit(False)
        seen = ranked.agg(
            F.count_if(above).alias("stopped"),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if seen["stopped"] == stopped or not seen["open"]:
            break
        stopped, share = seen["stopped"], (total - seen["held"]) / seen["open"]
    return ranked.select("source", "source_size", "n_docs", F.least(F.col("weight") * share, limit).alias("target"))


def _uniform(seed: int, *key) -> float:
    return xxhash.xxh64_intdigest(repr(key).encode(), seed) / 2.0**64


class Flight:
    """The open units of one group: lists of (chance, size, row), at most three at a time and the reserve."""

    def __init__(self, seed: int, name, reserve: int = 0):
        self.seed, self.name, self.units, self.steps = seed, name, [], 0
        self.reserve, self.kept = reserve, []

    def _waits(self, size: int) -> bool:
        """The largest units wait for the landing, and then one of each half of the size of the last."""
        if len(self.kept) < self.reserve // 2:
            return True
        return len(self.kept) < self.reserve and bool(size) and 2 * size <= self.kept[-1][1]

    def _move(self, way: tuple) -> None:
        """Along ``way``, or against it, until a chance is 0 or 1; the expected chances stay."""
        up = down = float("inf")
        for (chance, *_), w in zip(self.units, way):
            if w > 0:
                up, down = min(up, (1 - chance) / w), min(down, chance / w)
            elif w < 0:
                up, down = min(up, chance / -w), min(down, (1 - chance) / -w)
        self.steps += 1
        length = up if _uniform(self.seed, self.name, self.steps) * (up + down) < down else -down
        for unit, w in zip(self.units, way):
            unit[0] = min(1.0, max(0.0, unit[0] + length * w))

    def _settled(self) -> list[list]:
        done = [u for u in self.units if not SETTLED < u[0] < 1 - SETTLED]
        self.units = [u for u in self.units if SETTLED < u[0] < 1 - SETTLED]
        for unit in done:
            unit[0] = float(round(unit[0]))
        return done

    def add(self, chance: float, size: int, row) -> list[list]:
        """Take a unit in; the units that are decided by it come back."""
        self.units.append([chance, size, row])
        done = self._settled()
        if not done and self._waits(size):
            self.kept.append(self.units.pop())
        while True:
            sizes = [u[1] for u in self.units]
            if len(sizes) > 1 and sizes[0] == sizes[1]:
                way = (1, -1, 0)
            elif len(sizes) == 3:
                # null vector of the rows (1, 1, 1) and (sizes)
                way = (sizes[2] - sizes[1], sizes[0] - sizes[2], sizes[1] - sizes[0])
            else:
                return done
            self._move(way)
            done += self._settled()

    def land(self) -> list[list]:
        """Decide the few left together: of all subsets near the document total, one near the token total."""
        units, self.units, self.kept = self.units + self.kept, [], []
        if not units:
            return []
        chances, sizes = (np.array([u[i] for u in units], dtype=float) for i in (0, 1))
        taken = np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1
        off = np.abs(taken @ sizes - chances @ sizes) + 1e12 * (np.abs(taken.sum(axis=1) - chances.sum()) >= 1)
        best = np.argsort(off, kind="stable")[:LANDING_CHOICES]
        best = best[off[best] < 1e12]
        for unit, take in zip(units, taken[best[int(_uniform(self.seed, self.name, "land") * len(best))]].tolist()):
            unit[0] = float(take)
        return units

    def leave(self) -> list[list]:
        """What is still open, with the chances reached so far."""
        open_units, self.units = self.units, []
        return open_units


def _fly(seed: int, landing: bool):
    """A pass over rows sorted by group, holding three rows; decided rows have chance 0 or 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight = None

        def end():
            return [] if flight is None else flight.land() if landing else flight.leave()

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                name = (row["key"], row["flight"])
                if flight is None or flight.name != name:
                    done += end()
                    flight = Flight(seed, name, LANDING_RESERVE if landing else 0)
                done += flight.add(row["chance"], row["size"], row)
            yield _batch(done, batch.schema)
            schema = batch.schema
        if flight is not None:
            yield _batch(end(), schema)

    return run


def _batch(units: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{**row, "chance": chance} for chance, _, row in units], schema=schema)


def _passes(units: DataFrame, seed: int, flight_rows: int) -> DataFrame:
    """Flights of ``flight_rows`` units, each leaving at most two open, until a source is one flight; then it lands."""
    decided, level = [], 0
    while True:
        counts = materialise(
            units.groupBy("key").agg(F.count(F.lit(1)).alias("_units"))
            .withColumn("_flights", F.ceil(F.col("_units") / flight_rows)), "flights",
        )
        landing = (counts.agg(F.max("_flights")).first()[0] or 0) <= 1
        dealt = (
            lookup_join(units, counts, "key", "_units")
            .withColumn("flight", F.pmod(F.xxhash64("id", "size", F.lit(seed + level)), "_flights")).drop("_flights")
            .repartition("key", "flight").sortWithinPartitions("key", "flight", F.desc("size"), "id")
        )
        flown = materialise(dealt.mapInArrow(_fly(seed + level, landing), dealt.schema).drop("flight"), "flown")
        decided.append(flown.where("chance in (0.0D, 1.0D)"))
        if landing:
            return reduce(DataFrame.unionByName, decided)
        units = flown.where("chance not in (0.0D, 1.0D)")
        level += 1


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, flight_rows: int = FLIGHT_ROWS,
) -> DataFrame:
    """``(id, source, size, source_size, target, times, taken)`` for every row of ``docs``.

    ``size`` counts words; a source is to give ``target`` words, so each of its documents is taken
    floor or ceil of target / source_size times.  The fraction is drawn by the cube method: chances
    move inside the null space of the document and token totals, three open documents at a time, until all
    but two of a flight are 0 or 1.  The open ones of all flights fly again
    until each source is a single flight.  A dozen documents of many sizes wait for the landing, a choice
    among all their subsets.

    The result is a function of the rows and ``seed``, not of partitions.  A null text has size 0; a null
    source is a source of its own, the last; a source without words takes none.  Repeated rows
    are drawn one by one.  Other columns are not read.
    """
    sizes = materialise(
        docs.select(
            col(id_col).alias("id"), col(source_col).alias("source"),
            F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        ),
        "sizes",
    )
    # a null source gets a key of its own
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    ratio = F.when(
        F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))
    ).otherwise(0.0)
    shares = materialise(source_targets(sizes, weights, most).withColumn("ratio", ratio).select(
        key.alias("key"), "source_size", "target", F.floor("ratio").alias("base"),
        (F.col("ratio") - F.floor("ratio")).alias("chance"), "n_docs",
    ), "shares")
    units = lookup_join(sizes.withColumn("key", key), shares, "key", "n_docs")
    times = (F.col("base") + F.col("chance").cast("bigint")).alias("times")
    return _passes(units, seed, flight_rows).select("id", "source", "size", "source_size", "target", times).withColumn(
        "taken", F.col("times") * F.col("size")
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows that share an id, a source and a text are drawn as one.

    A row without an id can't be told from others by name; it stays once.
    """
    named = docs.where(col(id_col).isNotNull())
    # rows are drawn by what they are, whether others repeat an id or not
    same = F.struct(col(id_col).cast("string").alias("id"), col(source_col).cast("string").alias("source"), F.sha2(col(text_col), 256).alias("text"))
    one = named.withColumn("_draw", F.sha2(F.to_json(same), 256))
    if not one.groupBy("_draw").count().where("count > 1").isEmpty():
        one = one.dropDuplicates(["_draw"])
    drawn = mix(one, "_draw", text_col, source_col, **options)
    times = materialise(drawn.select(F.col("id").alias("_id"), F.col("times").alias("_times")), "times")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias("_copy")
    columns = [col(c) for c in docs.columns]
    taken = one.join(times, F.col("_draw") == F.col("_id")).where("_times > 0").select(*columns, copies).drop("_copy")
    return taken.union(docs.where(col(id_col).isNull()).select(*columns))

