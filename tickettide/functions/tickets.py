"""Ticket rules: open or closed, resolution time, SLA limit, raw payload."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickettide.functions.text import is_blank
from tickettide.functions.times import parse_time, seconds_between

# Labels for blank fields.
NO_CATEGORY = "Uncategorised"
NO_VALUE = "Unknown"
NO_ITEM = "Unspecified Item"
NO_TYPE = "Unspecified Type"

# States in which a change request is finished.
TERMINAL_STATES = ("closed", "complete", "completed", "cancelled", "canceled")

# Hours allowed to resolve an incident, by priority.
SLA_LIMIT_HOURS = {"1": 4, "2": 8, "3": 24, "4": 72}
SLA_DEFAULT_HOURS = 120


def is_open(closed_at: Column) -> Column:
    return is_blank(closed_at)


def open_flag(closed_at: Column) -> Column:
    """1 while the ticket has no closing time, else 0."""
    return is_open(closed_at).cast("int")


def is_terminal(state: Column) -> Column:
    """True in a finished state; case is ignored, blanks around the word are not."""
    return F.lower(F.coalesce(state, F.lit(""))).isin(*TERMINAL_STATES)


def started_text() -> Column:
    return F.coalesce("opened_at", "sys_created_on")


def finished_text(strict: bool = False) -> Column:
    """When the incident was done with.

    The loose reading falls back to the last update, so tickets still open
    count as resolved too; the strict one takes a resolving or closing time only.
    An empty text stops the fallback: such a row has no duration.
    """
    if strict:
        return F.coalesce(
            F.nullif(F.col("resolved_at"), F.lit("")), F.nullif(F.col("closed_at"), F.lit(""))
        )
    return F.coalesce("resolved_at", "closed_at", "sys_updated_on")


def resolution_seconds(strict: bool = False) -> Column:
    return seconds_between(parse_time(started_text()), parse_time(finished_text(strict)))


def sla_limit_hours(
    priority: Column,
    limits: Mapping[str, int] = SLA_LIMIT_HOURS,
    default: int = SLA_DEFAULT_HOURS,
) -> Column:
    """Hours allowed for a priority; any other text takes the default."""
    limit = F
    for text, allowed in limits.items():
        limit = limit.when(priority == text, allowed)
    return F.lit(default) if limit is F else limit.otherwise(default)


def breached(seconds: Column, limit_hours: Column) -> Column:
    """True where the limit is exceeded; exactly on it is no breach."""
    return F.coalesce(seconds > limit_hours.cast("bigint") * 3600, F.lit(False))


def raw_payload(columns: list[str]) -> Column:
    """The whole record as compact JSON, NULL fields included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def pick_value(field: Column, part: str = "value") -> Column:
    """Text of a field sent either plain or as ``{"display_value", "value"}``."""
    wrapped = field.rlike(r'^\s*\{\s*"(display_value|value)"\s*:')
    return F.when(wrapped, F.get_json_object(field, f"$.{part}")).otherwise(field)


def pick_field(record: Column, name: str, part: str = "value") -> Column:
    """Text of a parsed record's field sent either plain or as an object of ``display_value`` and ``value``.

    `record` is a VARIANT, parsed once for all fields. Other objects and lists
    come as their JSON; numbers without zeros at their end.
    """
    def at(*path: str, kind: str = "string") -> Column:
        return F.try_variant_get(record, ".".join(["$", name, *path]), kind)

    wrapped = at("value", kind="variant").isNotNull() | at("display_value", kind="variant").isNotNull()
    return F.when(wrapped, at(part)).otherwise(at())
