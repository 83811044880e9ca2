"""Time expressions over text timestamps. All wall-clock values are UTC."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE_LEAD = r"^\d{4}-\d{2}-\d{2}"
_ZONE_TAIL = r"(Z|[+-]\d{2}:?\d{2})$"


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def utc_of(instant: Column) -> Column:
    """UTC wall-clock time of an instant, whatever the session's zone."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return _epoch() + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def instant_of(moment: Column) -> Column:
    """The instant, to the second, of a UTC wall-clock time."""
    return F.timestamp_seconds(seconds_between(_epoch(), moment))


def utc_now() -> Column:
    """The current UTC wall-clock time."""
    return utc_of(F.current_timestamp())


def as_time(moment: Column | datetime | date | str | None) -> Column:
    """A UTC wall-clock column from whatever the caller has; None means now."""
    if moment is None:
        return utc_now()
    if isinstance(moment, datetime) and moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    column = moment if isinstance(moment, Column) else F.lit(str(moment))
    return column.cast("timestamp_ntz")


def second_text(moment: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``."""
    return F.substring(moment.cast("string"), 1, 19)


def minute_text(moment: Column) -> Column:
    """``YYYY-MM-DD HH:MM``."""
    return F.substring(moment.cast("string"), 1, 16)


def to_second(moment: Column) -> Column:
    """The time without its fraction of a second."""
    return second_text(moment).cast("timestamp_ntz")


def parse_time(text: Column) -> Column:
    """UTC time from text, NULL where the text is not a date or a date-time.

    Text must start with ``YYYY-MM-DD``: a plain cast would also take ``2026``
    or ``12:00``. A trailing ``Z`` or offset is honoured; other text is UTC.
    """
    zoned = (F.length(text) > 19) & text.rlike(_ZONE_TAIL)
    return F.when(
        text.rlike(_DATE_LEAD),
        F.when(zoned, utc_of(text.try_cast("timestamp"))).otherwise(text.try_cast("timestamp_ntz")),
    )


def parse_date(text: Column) -> Column:
    """Date from text, NULL where it is not one."""
    return F.when(text.rlike(_DATE_LEAD), text.try_cast("date"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, both without a zone."""
    return (end - start).cast("interval second").cast("bigint")


def shift_days(moment: Column, days: int) -> Column:
    return moment + F.make_dt_interval(F.lit(days))


def rounded_ratio(numerator: Column, denominator: Column | int, places: int) -> Column:
    """``numerator / denominator`` rounded half away from zero, worked in integers.

    Rounding a double quotient depends on its last bit and so on the engine
    and on the order of summation; integer division does not. A column as
    denominator means the numerator is a sum, which gets room to grow.
    """
    if isinstance(denominator, int):
        num, den = numerator, F.lit(denominator).cast("bigint")
    else:
        num, den = numerator.cast("decimal(38,0)"), denominator.cast("decimal(38,0)")
    scale = 10 ** places
    rounded = F.call_function("div", F.abs(num) * F.lit(2 * scale) + den, den * F.lit(2))
    sign = F.signum(numerator).cast("int")
    return F.when(den != 0, sign * rounded / F.lit(float(scale)))


def age_days(opened: Column, as_of: Column) -> Column:
    """Age in days, to one decimal."""
    return rounded_ratio(seconds_between(opened, as_of), 86400, 1)


def hours(seconds: Column) -> Column:
    """Hours, to two decimals."""
    return rounded_ratio(seconds, 3600, 2)
