from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from tankline import operators as ops
from tankline.operators import intervals as rules

from .conftest import ms, readings_of, requests_of, shifts_of

A, B, C = ("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-03", 2)


def resolve(spark, rule, *asked, readings=(), **more):
    requests = requests_of(spark, [(1, *a, *b) for a, b in asked])
    rows = readings_of(spark, list(readings))
    got = ops.resolve_interval(requests, shifts_of(spark), rule, readings=rows, **more).collect()
    key = {(r.startdate.isoformat(), r.startshift, r.enddate.isoformat(), r.endshift): r for r in got}
    assert len(key) == len(asked)
    return [
        (key[(*a, *b)].bounds_status, key[(*a, *b)].time_from, key[(*a, *b)].time_to)
        for a, b in asked
    ]


def at(text):
    return datetime.fromisoformat(text)


def test_plus_12h_and_rollover(spark):
    reverse = (("2024-01-02", 2), B)
    assert resolve(spark, rules.PLUS_12H, (A, B), reverse) == [
        ("ok", at("2023-12-31 20:45"), at("2024-01-01 20:45")),
        ("ok", at("2024-01-02 08:45"), at("2024-01-01 20:45")),
    ]
    # Rolled over by a single day, which may still lie before the start.
    assert resolve(spark, rules.PLUS_12H_ROLLOVER, (B, A), reverse) == [
        ("ok", at("2024-01-01 08:45"), at("2024-01-02 08:45")),
        ("ok", at("2024-01-02 08:45"), at("2024-01-02 20:45")),
    ]


def test_next_rules_and_their_fallbacks(spark):
    newest = ("2024-01-03 10:00:00.500",)
    readings = [(1, "2024-01-02 00:00:00", 5), (1, *newest, 4), (2, "2024-01-09 00:00:00", 4)]
    asked = ((A, B), (A, C))
    assert resolve(spark, rules.NEXT_ONLY, *asked)[1][0] == "end_missing"
    assert resolve(spark, rules.NEXT_OR_12H, *asked)[1][2] == at("2024-01-03 20:45")
    last = resolve(spark, rules.NEXT_OR_LAST_READING, *asked, readings=readings)
    assert last[0][2] == at("2024-01-01 20:45")
    assert last[1][2] == at("2024-01-03 10:00:00.500")
    assert resolve(spark, rules.NEXT_OR_LAST_READING, *asked)[1][0] == "no_readings"
    unknown = ((A, ("2024-06-01", 1)),)
    assert resolve(spark, rules.NEXT_OR_LAST_READING, *unknown, readings=readings)[0][0] == "end_missing"


def test_one_shift_ignores_the_end(spark):
    assert resolve(spark, rules.ONE_SHIFT, (A, ("2030-01-01", 9)), (C, C)) == [
        ("ok", at("2023-12-31 20:45"), at("2024-01-01 08:45")),
        ("end_missing", at("2024-01-03 08:45"), None),
    ]


def test_next_by_number_needs_no_end_shift(spark):
    readings = [(1, "2024-01-03 10:00:00", 4)]
    got = resolve(
        spark, rules.NEXT_BY_NUMBER, (A, ("2024-01-01", 7)), (A, C), (A, B), readings=readings
    )
    assert [g[2] for g in got] == [
        at("2024-01-01 20:45"), at("2024-01-03 10:00"), at("2024-01-01 20:45")]
    # A newest reading before the start does not serve.
    early = [(1, "2023-01-01 00:00:00", 4)]
    assert resolve(spark, rules.NEXT_BY_NUMBER, (A, C), readings=early)[0][0] == "end_missing"


def test_end_shift_start_chain(spark):
    got = resolve(spark, rules.END_SHIFT_START, (A, C), (A, ("2024-06-01", 1)), (C, ("2024-06-01", 1)))
    assert [g[2] for g in got] == [
        at("2024-01-03 08:45"), at("2024-01-01 08:45"), at("2024-01-03 20:45")]


def test_calendar_days(spark):
    assert resolve(spark, rules.CALENDAR_DAYS, (A, C))[0][1:] == (at("2024-01-01"), at("2024-01-03"))
    assert resolve(spark, rules.CALENDAR_DAYS_FULL, (A, C))[0][2] == at("2024-01-04")


def test_problems_are_statuses_and_strict_raises(spark):
    missing = (("2024-06-01", 1), B)
    assert resolve(spark, rules.PLUS_12H, missing)[0][0] == "start_missing"
    assert resolve(spark, rules.NEXT_OR_12H, (B, A), validate=True)[0][0] == "invalid_interval"
    with pytest.raises(PySparkException):
        resolve(spark, rules.PLUS_12H, missing, strict=True)
    wrong = requests_of(spark, [(1, *B, *A), (1, *A, *B)])
    assert sorted(r.invalid for r in ops.validate_interval(wrong).collect()) == [False, True]
    with pytest.raises(PySparkException):
        ops.validate_interval(wrong, strict=True).collect()


def test_calendar_in_another_zone(spark):
    requests = requests_of(spark, [(1, *A, *B)])
    got = ops.resolve_interval(
        requests, shifts_of(spark), rules.NEXT_ONLY, tz="Etc/GMT-5"
    ).first()
    assert got.from_ms == ms("2023-12-31 15:45:00") and got.time_from == at("2023-12-31 20:45")


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        ops.resolve_interval(None, None, "no such rule")
