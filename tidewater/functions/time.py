"""Times as TIMESTAMP_NTZ, spans as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}


def parse(text: str | Column) -> Column:
    """A timestamp without zone: fractions beyond microseconds are cut, offsets dropped (wall clock kept), garbage is null."""
    c = F.col(text) if isinstance(text, str) else text
    return c.try_cast("timestamp_ntz")


def epoch(ts: str | Column) -> Column:
    """Seconds since 1970 as a double, in wall-clock time."""
    return micros(ts) / F.lit(1e6)


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 as a long, for frames by value."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def between(start: str | Column, end: str | Column, unit: str = "hours") -> Column:
    """end - start in a unit of SECONDS; null if one is null."""
    if unit not in SECONDS:
        raise ValueError(f"unknown unit: {unit}")
    return (epoch(end) - epoch(start)) / F.lit(SECONDS[unit])


def label_value(start: str | Column, end: str | Column, unit: str = "hours") -> Column:
    """As between(); an unknown unit counts as hours."""
    return between(start, end, unit if unit in SECONDS else "hours")


def first_midnight(ts: Column) -> Column:
    """The first midnight that isn't before ts."""
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    return F.when(day < ts, day + F.expr("interval 1 day")).otherwise(day)


def first_day(ts: Column) -> Column:
    """The number of the first midnight that isn't before ts, in days since 1970."""
    return F.unix_date(first_midnight(ts).cast("date"))


def midnight(day: Column) -> Column:
    return F.date_from_unix_date(day).cast("timestamp_ntz")


def elapsed_minutes(created: Column, t: Column) -> Column:
    """Minutes since created; -1 if t is before it or it is unknown."""
    return F.when(created.isNull() | (t < created), F.lit(-1.0)).otherwise(between(created, t, "minutes"))


def relative_x(t: Column, start: Column, end: Column, mode: str = "normalized") -> Column:
    """Progress in a cycle (0.0 for an empty one), or days until its end."""
    if mode == "normalized":
        span = epoch(end) - epoch(start)
        return F.when(span <= 0, F.lit(0.0)).otherwise((epoch(t) - epoch(start)) / span)
    if mode == "days_until_release":
        return between(t, end, "days")
    raise ValueError(f"unknown mode: {mode}")


def bin_index(t: Column, start: Column, end: Column, bins: int) -> Column:
    """The equal-time bin of t: 0 to bins - 1 within [start, end), negative before it."""
    return F.floor((epoch(t) - epoch(start)) / ((epoch(end) - epoch(start)) / F.lit(float(bins)))).cast("int")


def date_chunks(start: Column, end: Column, years: int | None) -> Column:
    """An array of structs (start, end): contiguous intervals cut at every so many years' first of January; one without years.

    A span that ends on such a day ends with an empty interval of that day alone.
    """
    if not years:
        return F.array(F.struct(start.alias("start"), end.alias("end")))
    first, last, step = F.year(start), F.year(end), F.lit(int(years))
    later = F.filter(F.sequence(first, F.greatest(first, last), step), lambda y: y > first)
    edges = F.concat(F.array(start), F.transform(later, lambda y: F.make_date(y, F.lit(1), F.lit(1)).cast("timestamp_ntz")), F.array(end))
    return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(F.element_at(edges, i).alias("start"), F.element_at(edges, i + 1).alias("end")))
