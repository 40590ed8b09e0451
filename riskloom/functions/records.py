"""Small functions of records as Columns: keyed digests, dates, JSON, arrays whose order counts, and checks of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA-256 of a text, built from two digests."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in block)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def hmac_sha256_sql(key: bytes, message: str) -> str:
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: "from_hex('" + bytes(b ^ x for b in block).hex() + "')"
    return f"sha256({pad(0x5C)} || from_hex(sha256({pad(0x36)} || encode({message}))))"


def epoch_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_merge(a: Column, b: Column) -> Column:
    """Two flat JSON objects as one with sorted names; the second's values win, as texts."""
    kind = "map<string,string>"
    one, two = (F.coalesce(F.from_json(x, kind), F.from_json(F.lit("{}"), kind)) for x in (a, b))
    rest = F.map_filter(one, lambda k, v: ~F.map_contains_key(two, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(rest, two)))))


def coerced(value: Column, fill: float = 0.0) -> Column:
    """A number read from a text; what is none is the fill."""
    return F.coalesce(value.try_cast("double"), F.lit(fill))


def binary_label(value: Column) -> Column:
    """Labels -1 and 1 as 0 and 1; others are null."""
    return F.when(value == -1, 0).when(value == 1, 1)


def sound_metric(value: Column) -> Column:
    """Whether a metric is a finite number that is not negative."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (value != float("inf")) & (value >= 0), F.lit(False))


def first_of_each(*arrays: Column) -> Column:
    """All values in their order, each at its first place only."""
    return F.array_distinct(F.concat(*arrays))


def readings(a: Column, b: Column, each: int = 8, most: int = 32) -> Column:
    """Every pair of one value of each array, of at most so many values and in all; first values first."""
    pairs = F.transform(F.slice(a, 1, each), lambda x: F.transform(F.slice(b, 1, each), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return F.slice(F.flatten(pairs), 1, most)


def breakdown(values: dict[str, Column], first: int = 10) -> Column:
    """Names of features ordered by value, suspicious ones (-1) first, then as they are listed; the first few."""
    rows = F.array(*[F.struct(v.alias("value"), F.lit(i).alias("place"), F.lit(n).alias("name")) for i, (n, v) in enumerate(values.items())])
    return F.transform(F.slice(F.array_sort(rows), 1, first), lambda r: r["name"])


#: Which status may follow which.
NEXT = {"pending": ("in_progress", "closed"), "in_progress": ("pending", "closed"), "closed": ("in_progress",)}


def transition_fault(old: Column, new: Column, verdict: Column, note: Column) -> Column:
    """Why a case may not go from one status to another, null if it may: an unknown step, closing without a verdict, or
    reopening without a note."""
    known = F.lit(False)
    for k, after in NEXT.items():
        known = known | ((old == k) & new.isin(*after))
    return (
        F.when(old == new, None).when(~known, "no such step").when((new == "closed") & verdict.isNull(), "closing needs a verdict")
        .when((old == "closed") & (F.trim(F.coalesce(note, F.lit(""))) == ""), "reopening needs a note")
    )
