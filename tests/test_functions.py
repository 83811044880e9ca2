from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickettide.functions import text, tickets, times


def values(spark, rows, *columns, schema="a string"):
    frame = spark.createDataFrame([(r,) for r in rows], schema)
    result = [tuple(r) for r in frame.select(*columns).collect()]
    return [r[0] for r in result] if len(columns) == 1 else result


TIMES = {
    "2024-01-02 03:04:05": datetime(2024, 1, 2, 3, 4, 5),
    "2024-01-02T03:04:05Z": datetime(2024, 1, 2, 3, 4, 5),
    "2024-01-02T03:04:05+02:00": datetime(2024, 1, 2, 1, 4, 5),
    "2024-01-02 03:04": datetime(2024, 1, 2, 3, 4),
    "2024-03-10 02:30:00": datetime(2024, 3, 10, 2, 30),  # no such time in New York
    "2024-01-02": datetime(2024, 1, 2),
    "": None,
    "abc": None,
    "2026": None,
    "12:00": None,
    "01/02/2026": None,
    "2024-13-01": None,
    None: None,
}


def test_parse_time(spark):
    assert values(spark, TIMES, times.parse_time(F.col("a"))) == list(TIMES.values())


def test_parse_time_does_not_depend_on_the_session_zone(other_zone):
    assert values(other_zone, TIMES, times.parse_time(F.col("a"))) == list(TIMES.values())


def test_parse_date(spark):
    got = values(spark, ["2024-01-02", "2024-01-02 10:00:00", "2026", ""], times.parse_date(F.col("a")))
    assert [str(d) for d in got] == ["2024-01-02", "2024-01-02", "None", "None"]


def test_seconds_across_a_clock_change(other_zone):
    start = times.parse_time(F.lit("2024-03-09 08:00:00"))
    end = times.parse_time(F.lit("2024-03-10 08:00:00"))
    assert other_zone.range(1).select(times.seconds_between(start, end)).first()[0] == 86400


@pytest.mark.parametrize(
    "seconds, expected",
    [(0, 0.0), (18, 0.01), (17, 0.0), (-18, -0.01), (3600, 1.0), (3618, 1.01), (3582, 1.0)],
)
def test_hours_round_half_away_from_zero(spark, seconds, expected):
    assert spark.range(1).select(times.hours(F.lit(seconds).cast("bigint"))).first()[0] == expected


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-10**15, 10**15), min_size=1, max_size=30), st.integers(1, 10**6))
def test_rounded_ratio_is_exact(spark, numbers, count):
    from decimal import ROUND_HALF_UP, Decimal

    frame = spark.createDataFrame([(n, count) for n in numbers], "n bigint, d bigint")
    got = [r[0] for r in frame.select(times.rounded_ratio(F.col("n"), F.col("d"), 2)).collect()]
    want = [
        float((Decimal(n) / Decimal(count)).quantize(Decimal("0.01"), ROUND_HALF_UP))
        if abs(n) < 10**20 else None
        for n in numbers
    ]
    assert got == pytest.approx(want, rel=1e-15)


def test_no_negative_zero(spark):
    assert str(spark.range(1).select(times.hours(F.lit(-17).cast("bigint"))).first()[0]) == "0.0"


def test_age_takes_the_given_moment(spark):
    opened = times.parse_time(F.lit("2024-01-01 00:00:00"))
    age = times.age_days(opened, times.as_time(datetime(2024, 1, 3, 13, 12)))
    assert spark.range(1).select(age).first()[0] == 2.6


def test_moments_do_not_depend_on_the_session_zone(other_zone):
    from datetime import date, timedelta, timezone

    noon = datetime(2024, 3, 10, 2, 30)
    same = [noon, str(noon), noon.replace(tzinfo=timezone.utc),
            (noon + timedelta(hours=3)).replace(tzinfo=timezone(timedelta(hours=3)))]
    row = other_zone.range(1).select(
        *(times.as_time(m).alias(f"m{i}") for i, m in enumerate(same)),
        times.as_time(date(2024, 3, 10)).alias("day"),
        times.utc_of(times.instant_of(F.lit("2024-03-10 02:30:00").cast("timestamp_ntz"))).alias("back"),
        times.to_second(F.lit("2024-03-10 02:30:00.75").cast("timestamp_ntz")).alias("cut"),
    ).first()
    assert set(row[:4]) == {noon} and row.day == datetime(2024, 3, 10) and row.back == row.cut == noon


def test_now_is_utc(other_zone):
    now = other_zone.range(1).select(times.utc_now()).first()[0]
    from datetime import timezone

    assert abs((now - datetime.now(timezone.utc).replace(tzinfo=None)).total_seconds()) < 60


def test_labels(spark):
    assert values(spark, [None, "", " ", "x"], text.label_blank(F.col("a"), "none")) == [
        "none", "none", " ", "x"]


NAMES = {
    "sales_q1_2026.xlsx": ("sales_q1_2026", ".xlsx"),
    "My Report (final).xlsx": ("my_report_final", ".xlsx"),
    "INVENTORY.XLSX": ("inventory", ".xlsx"),
    "a/b/archive.tar.gz": ("archive_tar", ".gz"),
    "C:\\in\\Old.XLS": ("old", ".xls"),
    ".xlsx": ("xlsx", ""),
    "((..csv": ("data", ".csv"),
    "???": ("data", ""),
    "plain": ("plain", ""),
    "": ("data", ""),
}


def test_table_names_and_extensions(spark):
    got = values(spark, NAMES, text.table_name(F.col("a")), text.file_extension(F.col("a")))
    assert got == list(NAMES.values())


def test_clean_name():
    assert [text.clean_name(n) for n in ("  First Name ", "Amount $", "Region", "7")] == [
        "first_name", "amount_$", "region", "7"]  # the first three are fixed values
    assert [text.clean_name(n) for n in ("a \t b\nC", "\u00a0x  y", "")] == ["a_b_c", "x_y", ""]


def test_terminal_states(spark):
    states = ["Closed", "COMPLETE", "completed", "Cancelled", "canceled", "New", "", None, " closed"]
    assert values(spark, states, tickets.is_terminal(F.col("a"))) == [True] * 5 + [False] * 4


def test_open_flag(spark):
    assert values(spark, [None, "", "2024-01-01"], tickets.open_flag(F.col("a"))) == [1, 1, 0]


def test_sla_limits(spark):
    priorities = ["1", "2", "3", "4", "5", "Unknown", "1 - Critical", "", None]
    assert values(spark, priorities, tickets.sla_limit_hours(F.col("a"))) == [
        4, 8, 24, 72, 120, 120, 120, 120, 120]
    assert values(spark, ["1", "2"], tickets.sla_limit_hours(F.col("a"), {}, 10)) == [10, 10]


def test_pick_value(spark):
    fields = [
        '{"value":"1","display_value":"Critical"}',
        '{"display_value": "Critical", "value": "1"}',
        '{"value":null,"display_value":""}',
        "plain", "", None, "{broken} printer", '{"k": 1}',
    ]
    assert values(spark, fields, tickets.pick_value(F.col("a"))) == [
        "1", "1", None, "plain", "", None, "{broken} printer", '{"k": 1}']
    assert values(spark, fields[:1], tickets.pick_value(F.col("a"), "display_value")) == ["Critical"]


def test_raw_payload_keeps_nulls(spark):
    frame = spark.createDataFrame([("1", None, 'a "b"\n')], "x string, y string, z string")
    assert frame.select(tickets.raw_payload(["x", "y", "z"])).first()[0] == (
        '{"x":"1","y":null,"z":"a \\"b\\"\\n"}')
