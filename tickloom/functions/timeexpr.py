"""Time arithmetic as native column expressions (UTC throughout).

Buckets lie on a raster that starts at each UTC midnight, for any length from one second to one day.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400
DAY_MS = DAY_S * 1000


def _check_length(seconds: int) -> int:
    if not 1 <= int(seconds) <= DAY_S:
        raise ValueError(f"bucket length must be 1..{DAY_S} seconds, got {seconds}")
    return int(seconds)


def bucket_s(second: Column, seconds: int) -> Column:
    """Start (epoch seconds) of the bucket that holds an epoch second."""
    second = second.cast("long")
    return second - F.pmod(F.pmod(second, F.lit(DAY_S)), F.lit(_check_length(seconds)))


def bucket_ms(ms: Column, seconds: int) -> Column:
    """Start (epoch ms) of the bucket that holds an epoch millisecond."""
    ms = ms.cast("long")
    return ms - F.pmod(F.pmod(ms, F.lit(DAY_MS)), F.lit(_check_length(seconds) * 1000))


def raster_starts(day: Column, first_ms: int, end_ms: int, step_ms: int) -> Column:
    """All bucket starts of the day that begins at ``day`` (epoch ms), as far as they lie in ``[first_ms, end_ms)``."""
    if not 1 <= step_ms <= DAY_MS:
        raise ValueError(f"bucket length must be 1..{DAY_MS} ms, got {step_ms}")
    low = day + F.ceil(F.greatest(F.lit(first_ms) - day, F.lit(0)) / step_ms) * step_ms
    high = F.least(day + DAY_MS, F.lit(end_ms)) - 1
    return F.when(low <= high, F.sequence(low, high, F.lit(step_ms).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def raster_cells(first_ms: int, end_ms: int, step_ms: int) -> int:
    """The number of bucket starts in ``[first_ms, end_ms)``."""

    def before(ms: int) -> int:  # since the epoch's midnight
        return ms // DAY_MS * -(-DAY_MS // step_ms) + -(-(ms % DAY_MS) // step_ms)

    return max(before(end_ms) - before(first_ms), 0)


def bucket_s_to_ms(second: Column, seconds: int) -> Column:
    return bucket_s(second, seconds) * 1000


def bucket_iso(ms: Column, seconds: int) -> Column:
    return iso_instant(bucket_ms(ms, seconds))


def iso_instant(ms: Column) -> Column:
    """ISO-8601 instant with a ``Z``; milliseconds only where they are not zero."""
    stamp = F.timestamp_millis(ms)
    return F.when(
        F.pmod(ms, F.lit(1000)) == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def _day(value: Column, length: int) -> Column:
    days = ((value - F.pmod(value, F.lit(length))) / length).cast("int")
    return F.date_from_unix_date(days).cast("string")


def day_of_s(second: Column) -> Column:
    return _day(second, DAY_S)


def day_of_ms(ms: Column) -> Column:
    return _day(ms, DAY_MS)


def day_of_ts(stamp: Column) -> Column:
    return day_of_s(F.unix_seconds(stamp))


def month_of_s(second: Column) -> Column:
    return F.substring(day_of_s(second), 1, 7)


def month_of_ms(ms: Column) -> Column:
    return F.substring(day_of_ms(ms), 1, 7)


def month_of_ts(stamp: Column) -> Column:
    return month_of_s(F.unix_seconds(stamp))


def month_of_day(day: Column) -> Column:
    return F.substring(day, 1, 7)


def minute_start_s(second: Column) -> Column:
    return second.cast("long") - F.pmod(second, F.lit(60))


def minute_iso(second: Column) -> Column:
    return iso_instant(minute_start_s(second) * 1000)


def minute_of_day_s(second: Column, minutes: int) -> Column:
    """Minute of the UTC day, floored to a multiple of ``minutes``."""
    in_day = F.pmod(second, F.lit(DAY_S))
    minute = ((in_day - F.pmod(in_day, F.lit(60))) / 60).cast("int")
    return minute - F.pmod(minute, F.lit(minutes))


def minute_of_day_ms(ms: Column, minutes: int) -> Column:
    return minute_of_day_s(((ms - F.pmod(ms, F.lit(1000))) / 1000).cast("long"), minutes)


def provider_time_to_ms(text: Column) -> Column:
    """``yyyy-MM-dd'T'HH:mm:ss`` with up to seven decimals, read as UTC, to epoch ms."""
    whole = F.unix_seconds(F.to_timestamp(F.concat(F.substring(text, 1, 19), F.lit("Z")), "yyyy-MM-dd'T'HH:mm:ssX"))
    millis = F.rpad(F.substring(text, 21, 3), 3, "0").cast("long")
    return whole * 1000 + millis


def day_arg_to_ms(day: str) -> int:
    """A ``yyyy-MM-dd`` job argument as epoch ms of its UTC midnight."""
    parsed = date.fromisoformat(day)
    return int(datetime(parsed.year, parsed.month, parsed.day, tzinfo=timezone.utc).timestamp()) * 1000


def instant_arg_to_ms(text: str) -> int:
    """An ISO date-time job argument with a zone as epoch ms."""
    parsed = datetime.fromisoformat(text)
    if parsed.tzinfo is None:
        raise ValueError(f"time zone missing in {text!r}")
    seconds = int(parsed.replace(microsecond=0).timestamp())
    return seconds * 1000 + parsed.microsecond // 1000


def ms_to_day_arg(ms: int) -> str:
    return datetime.fromtimestamp(ms // 1000, tz=timezone.utc).date().isoformat()
