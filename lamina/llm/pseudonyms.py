"""Personal data: format-preserving Feistel pseudonyms, as column expressions only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.text import col

ROUNDS = 8
# Steps of a walk back into the domain; each leaves it again with a chance of 0.6 at most.
WALK = 64
# The shapes that are looked at, first match first.  What a shape matches is validated before it is replaced.
SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)",
}
PATTERN = "|".join(SHAPES.values())
FIRST_DAY, DAYS = "1900-01-01", 73049


def _keyed(key: str, label: str, *parts: Column) -> Column:
    """A number below 2 ** 48 from the key, a label and some values."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def permuted(value: Column, size: int, key: str, label: str, valid=None) -> Column:
    """A keyed permutation of 0 .. size - 1, or of those of them for which ``valid`` holds.

    The number is a pair (high, low); each of eight rounds shifts one of them by a keyed function of the other.  A
    result outside the domain goes through the rounds again until it is inside.
    """
    low_size = isqrt(size - 1) + 1
    high_size = -(-size // low_size)

    def rounds(v: Column) -> Column:
        def step(pair: Column, r: Column) -> Column:
            low = F.pmod(pair["low"] + _keyed(key, label, r, pair["high"]), F.lit(low_size))
            high = F.pmod(pair["high"] + _keyed(key, label, r, pair["low"]), F.lit(high_size))
            even = r % 2 == 0
            return F.struct(F.when(even, low).otherwise(pair["low"]).alias("low"), F.when(even, pair["high"]).otherwise(high).alias("high"))

        first = F.struct(F.pmod(v, F.lit(low_size).cast("bigint")).alias("low"), F.floor(v / F.lit(low_size)).cast("bigint").alias("high"))
        if size > 1 << 52:
            # beyond the exact doubles: divide in whole numbers
            first = F.struct(F.pmod(v, F.lit(low_size).cast("bigint")).alias("low"), F.call_function("div", v, F.lit(low_size).cast("bigint")).alias("high"))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, lambda p: p["high"] * F.lit(low_size).cast("bigint") + p["low"]
        )

    def inside(v: Column) -> Column:
        fits = v < F.lit(size)
        return fits if valid is None else fits & valid(v)

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.struct(value.cast("bigint").alias("v"), F.lit(False).alias("done")),
        lambda a, _: F.when(a["done"], a).otherwise(bound(rounds(a["v"]), lambda v: F.struct(v.alias("v"), inside(v).alias("done")))),
    )
    return bound(walked, lambda w: F.when(w["done"], w["v"]).otherwise(value.cast("bigint")))


def bound(value: Column, build) -> Column:
    """``build`` of a value that is worked out once, however often ``build`` names it."""
    return F.element_at(F.transform(F.array(value), lambda v: build(v)), 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""
    return bound(digits, lambda d: _filled(shape, d))


def _filled(shape: Column, digits: Column) -> Column:
    filled = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(
            c.rlike("^[0-9]$"), F.struct(F.concat(a["out"], F.substring(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
    )
    return filled["out"]


def _luhn(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum modulo 10; ``doubled_last`` for a number that lacks its check digit."""
    first = 0 if doubled_last else 1
    return F.aggregate(
        F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(
            (i % 2) == first, (c.cast("int") * 2) % 10 + F.when(c.cast("int") > 4, 1).otherwise(0)
        ).otherwise(c.cast("int"))),
        F.lit(0), lambda a, d: a + d,
    ) % 10


def _sized(digits: Column, sizes: range, build) -> Column:
    """``build(n)`` for the digits' own count; a permutation needs its domain as a constant."""
    result = F.lit(None).cast("string")
    for n in sizes:
        result = F.when(F.length(digits) == n, build(n)).otherwise(result)
    return result


def _card(m: Column, key: str) -> Column:
    def build(digits: Column, n: int) -> Column:
        body = F.substring(digits, 1, n - 1).cast("bigint")
        moved = F.lpad(permuted(body, 10 ** (n - 1), key, f"card{n}").cast("string"), n - 1, "0")
        return bound(moved, lambda d: F.concat(d, F.pmod(10 - _luhn(d, True), F.lit(10)).cast("string")))

    return bound(digits_of(m), lambda d: F.when(
        _luhn(d, False) == 0, refilled(m, _sized(d, range(13, 20), lambda n: build(d, n)))
    ))


def _phone(m: Column, key: str) -> Column:
    """The last ten digits, or all of a shorter number, so that one number links in all its spellings."""
    def build(digits: Column, n: int) -> Column:
        own = F.substring(digits, -n, n).cast("bigint")
        moved = F.lpad(permuted(own, 10 ** n, key, f"phone{n}").cast("string"), n, "0")
        return F.concat(F.substring(digits, F.lit(1), F.length(digits) - n), moved)

    return bound(digits_of(m), lambda d: refilled(
        m, F.when(F.length(d) >= 10, build(d, 10)).otherwise(_sized(d, range(7, 10), lambda n: build(d, n)))
    ))


def _ip(m: Column, key: str) -> Column:
    def written(moved: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(moved, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])

    def build(parts: Column) -> Column:
        value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
        return F.when(F.forall(parts, lambda p: p <= 255), bound(permuted(value, 1 << 32, key, "ip"), written))

    return bound(F.transform(F.split(m, r"\."), lambda p: p.cast("bigint")), build)


def _ssn(m: Column, key: str) -> Column:
    def known(v: Column) -> Column:
        area, group, serial = F.floor(v / 1_000_000), F.floor(v / 10_000) % 100, v % 10_000
        return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)

    return bound(digits_of(m).cast("bigint"), lambda v: F.when(
        known(v), refilled(m, F.lpad(permuted(v, 10 ** 9, key, "ssn", known).cast("string"), 9, "0"))
    ))


def _date(m: Column, key: str) -> Column:
    """The day is permuted among 1900 to 2099 and written as the date was: order, separators and leading zeros."""
    year_first = m.rlike(r"^\d{4}")
    mark = F.regexp_extract(m, "[-/.]", 0)
    padded = m.rlike(r"(^|\D)0\d") | ~m.rlike(r"(^|\D)\d(\D|$)")

    def build(parts: Column) -> Column:
        day_first = ~year_first & (parts[1] <= 12)
        year = F.when(year_first, parts[0]).otherwise(parts[2])
        month = F.when(year_first | day_first, parts[1]).otherwise(parts[0])
        day = F.when(year_first, parts[2]).when(day_first, parts[0]).otherwise(parts[1])
        date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")

        def written(moved: Column) -> Column:
            d = F.when(padded, F.date_format(moved, "dd")).otherwise(F.date_format(moved, "d"))
            mon = F.when(padded, F.date_format(moved, "MM")).otherwise(F.date_format(moved, "M"))
            y = F.date_format(moved, "yyyy")
            return F.when(year_first, F.concat(y, mark, mon, mark, d)).when(
                day_first, F.concat(d, mark, mon, mark, y)
            ).otherwise(F.concat(mon, mark, d, mark, y))

        return bound(F.datediff(date, F.lit(FIRST_DAY).cast("date")), lambda n: F.when(
            (n >= 0) & (n < DAYS),
            bound(F.date_add(F.lit(FIRST_DAY).cast("date"), permuted(n, DAYS, key, "date").cast("int")), written),
        ))

    return bound(F.transform(F.split(m, "[-/.]"), lambda p: p.cast("int")), build)


def _email(m: Column, key: str) -> Column:
    local, domain = F.regexp_extract(m, "^[^@]+", 0), F.regexp_extract(m, "@.*$", 0)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.when(F.length(local) > 0, F.concat(F.lit("user"), F.substring(digest, 1, 16), domain))


def _secret(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(m)), 256)
    moved = F.substring(digest, F.lit(1), F.length(m))
    mixed = m.rlike("[0-9]") & m.rlike("[a-fA-F]")
    return F.when(mixed, F.when(m.rlike("[A-F]"), F.upper(moved)).otherwise(moved))


MAKERS = {"email": _email, "secret": _secret, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def _kind(m: Column) -> Column:
    """Which shape a match has; the looks around it held when it was found."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike("^[0-9a-fA-F]{32,}$"), "secret")
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})$"), "date")
        .when(m.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ip").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^(\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5})$"), "card").otherwise("phone")
    )


def _made(m: Column, kind: Column, key: str) -> Column:
    """Pseudonym and kind, or the match itself and no kind if it isn't valid; only its own kind's work is done."""
    value = F.lit(None).cast("string")
    for name, maker in MAKERS.items():
        value = F.when(kind == name, maker(m, key)).otherwise(value)
    return bound(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), F.coalesce(v, m).alias("value")))


def _counter(name: str):
    return lambda kind: kind == name


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_replaced, replaced)`` for every row of ``docs``: the text with pseudonyms and how many of each kind.

    Card numbers (Luhn), IPv4 addresses, social security numbers, dates of 1900 to 2099 and telephone numbers are permuted within their
    format under ``key``, by a Feistel network over the number that they write: a pseudonym is valid
    again, different values get different pseudonyms, and equal values get equal ones in all documents.  Local parts of mail addresses and hexadecimal secrets become
    keyed hashes.  What has the shape but isn't valid stays.  Everything is one projection without a shuffle.

    A null text stays null and has nothing replaced.  Repeated rows get equal results.  Other columns are not read.
    """
    text = col(text_col)
    found = docs.select(col(id_col).alias("id"), text.alias("text"), F.when(
        text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))
    ).alias("matches"))

    def named(m: Column) -> Column:
        return bound(_kind(m), lambda kind: _made(m, kind, key))

    done = found.withColumn("made", F.when(F.size("matches") > 0, F.transform("matches", named)))
    pieces = F.split("text", PATTERN, -1)
    glue = F.concat(F.transform("made", lambda x: x["value"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.flatten(F.zip_with(pieces, glue, lambda p, g: F.array(p, g))), "")
    kinds = F.filter(F.transform(F.coalesce("made", F.expr("array()").cast("array<struct<kind:string,value:string>>")), lambda x: x["kind"]), lambda k: k.isNotNull())
    counted = F.map_from_arrays(
        F.array(*map(F.lit, SHAPES)), F.array(*[F.size(F.filter("kinds", _counter(n))) for n in SHAPES])
    )
    return done.withColumn("kinds", kinds).select(
        "id", F.when(F.col("made").isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
        F.size("kinds").alias("n_replaced"), F.map_filter(counted, lambda _, n: n > 0).alias("replaced"),
    )
