"""Publish times, wall clocks and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsweave import params as P
from newsweave.functions.core import let


def reject_future(ts: Column, now: Column) -> Column:
    """A publish time more than a day ahead is a feed error."""
    return F.when(ts <= now + F.expr("INTERVAL 24 HOURS"), ts)


def effective_time(published: Column, fetched: Column) -> Column:
    return F.coalesce(published, fetched)


def _zone_offset(epoch: Column, zone: str) -> Column:
    instant = F.timestamp_seconds(epoch)
    return F.unix_timestamp(F.from_utc_timestamp(instant, zone)) - epoch


def wall_clock_to_utc(
    year: Column, month: Column, day: Column, hour: Column, minute: Column, zone: str = P.ZONE
) -> Column:
    """Instant of a wall-clock reading; null for dates that do not exist.

    A reading that occurs twice (clocks set back) is taken as the later one, a
    reading that never occurs (clocks set forward) as if the old offset held.
    """
    zero = F.lit(0)
    date = F.to_date(
        F.call_function("try_make_timestamp_ntz", year, month, day, zero, zero, zero)
    )
    inside_day = (hour * 60 + minute) < 24 * 60
    naive = F.when(
        inside_day,
        F.unix_date(date).cast("bigint") * 86400
        + hour.cast("bigint") * 3600
        + minute.cast("bigint") * 60,
    )

    def to_utc(wall: Column) -> Column:
        guess = wall - _zone_offset(wall, zone)
        return let(guess, lambda instant: F.timestamp_seconds(wall - _zone_offset(instant, zone)))

    return let(naive, to_utc)


# --- fixed value: how pages print dates ---
_DATE = r"(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})\.?(?:[\s,]+(\d{1,2}):(\d{2}))?"


def visible_date(text: Column, now: Column, zone: str = P.ZONE) -> Column:
    """First plausible ``d.m.yyyy[, HH:MM]`` in the text: at most 30 days old, not in the future."""

    def read(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, _DATE, i)
        number = lambda i: part(i).try_cast("int")
        hour = F.when(part(4) == "", F.lit(12)).otherwise(number(4))
        minute = F.when(part(5) == "", F.lit(0)).otherwise(number(5))
        return wall_clock_to_utc(number(3), number(2), number(1), hour, minute, zone)

    plausible = lambda ts: (ts <= now + F.expr("INTERVAL 1 DAY")) & (
        ts >= now - F.expr("INTERVAL 30 DAYS")
    )
    found = F.regexp_extract_all(text, F.lit(_DATE), F.lit(0))
    return F.get(F.filter(F.transform(found, read), plausible), F.lit(0))


def date_label(ts: Column, zone: str = P.ZONE) -> Column:
    """``6. septembar 2026.`` in the given zone."""
    local = F.from_utc_timestamp(ts, zone)
    months = F.array(*[F.lit(m) for m in P.MONTHS])
    return F.concat(
        F.dayofmonth(local), F.lit(". "), F.element_at(months, F.month(local)),
        F.lit(" "), F.year(local), F.lit("."),
    )


def parse_feed_date(value: Column) -> Column:
    """RFC 822 or ISO 8601 text to an instant; null when it is neither."""
    text = F.regexp_replace(F.trim(value), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s*", "")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r" (GMT|UTC|UT|Z)$", " +0000")
    formats = (
        "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm",
    )
    rfc = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.when(text.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}"), r) for r in rfc])


def age_label(ts: Column, now: Column) -> Column:
    seconds = (F.unix_timestamp(now) - F.unix_timestamp(ts)).cast("bigint")
    minutes = F.floor(seconds / 60 + 0.5)
    return (
        F.when(minutes < 0, F.lit("u budućnosti (loš datum u feedu)"))
        .when(minutes < 60, F.concat(F.lit("pre "), minutes, F.lit(" min")))
        .when(minutes < 60 * 48, F.concat(F.lit("pre "), F.floor(minutes / 60 + 0.5), F.lit(" h")))
        .otherwise(F.concat(F.lit("pre "), F.floor(minutes / 1440 + 0.5), F.lit(" dana")))
    )


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600


def round_half_up(value: Column, decimals: int) -> Column:
    """Round as the editorial tools do: halves go up, also for negative values."""
    scale = 10**decimals
    return F.floor(value * scale + 0.5) / scale
