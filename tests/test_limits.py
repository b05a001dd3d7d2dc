"""Limits of single requests against plain loops, and against the forms with one limit for all."""

import random

import pytest
from pyspark.sql import functions as F

from tankline import operators as ops

from .conftest import ms, readings_of, windows_of

START = ms("2024-01-01 00:00:00")
FIVE = 300_000


@pytest.fixture(scope="module")
def data(spark):
    rows, levels = [], {}
    for e in range(12):
        rng = random.Random(e)
        t, x = START, 500.0
        for _ in range(rng.randint(0, 120)):
            t += FIVE * rng.choice([1, 1, 1, 2, 40])
            x = max(0.0, x + rng.choice([-250, -200, -60, -20, -20, -0.5, 0, 30, 60, 150, 160, 200, 230]))
            rows.append((e, t + rng.choice([0, 7, 299_999]), x))
            levels.setdefault(e, []).append((t, x))
    return readings_of(spark, rows), levels


def asked(spark, limits):
    """Every machine with several windows and limits: (eqmt, from, to, low, high)."""
    rng = random.Random(1)
    times = ["2024-01-01 00:00:00", "2024-01-01 00:05:00", "2024-01-01 03:20:00.001", "2024-01-01 09:59:59", "2024-01-02 00:00:00", "2024-01-05 00:00:00"]
    rows = [(e, a, b, rng.choice(limits), rng.choice(limits)) for e in range(13) for a in times for b in times]
    frame = windows_of(spark, [r[:3] for r in rows]).select("eqmt", "time_from", "time_to").distinct()
    low, high = (F.array([F.lit(x).cast("double") for x in limits]), F.array([F.lit(x).cast("double") for x in reversed(limits)]))
    pick = F.pmod(F.hash("eqmt", "time_from", "time_to"), F.lit(len(limits)))
    return ops.interval_of_times(frame.withColumns({"low": F.get(low, pick), "high": F.get(high, pick)}))


def changes(levels, r):
    steps = [(t, a - b) for (_, a), (t, b) in zip(levels, levels[1:])]
    return [d for t, d in steps if r.from_ms <= t <= r.to_ms]


LIMITS = [20.0, 0.0, 150.0, None, 200.0, 60.0]


def test_drops(spark, data):
    readings, levels = data
    requests = asked(spark, LIMITS).withColumnRenamed("high", "max_drop")
    for default in (None, 60):
        rows = ops.fuel_used_drops(readings, requests, max_drop=default).collect()
        assert len(rows) == requests.count()
        for r in rows:
            limit = r.max_drop if r.max_drop is not None else 10**9 if default is None else default
            want = sum(d for d in changes(levels.get(r.eqmt, []), r) if 0 < d < limit)
            assert float(r.fuel_used) == pytest.approx(round(want, 1)), r


@pytest.mark.parametrize("cap_rises", [True, False])
def test_drops_and_rises(spark, data, cap_rises):
    readings, levels = data
    requests = asked(spark, LIMITS).withColumnsRenamed({"low": "refuel_threshold", "high": "max_step_drop"})
    for r in ops.clean_drop_rise(readings, requests, cap_rises=cap_rises).collect():
        low = 150 if r.refuel_threshold is None else r.refuel_threshold
        high = 200 if r.max_step_drop is None else r.max_step_drop
        found = changes(levels.get(r.eqmt, []), r)
        drops = [d for d in found if 0 < d <= high]
        rises = [-d for d in found if -d > low and d < 0 and (not cap_rises or -d <= high)]
        got = (float(r.total_used), float(r.total_refueled), r.valid_points, r.total_points)
        assert got == pytest.approx((sum(drops), sum(rises), len(drops) + len(rises), len(found))), r


def test_equal_limits_equal_the_form_for_all(spark, data):
    readings, _ = data
    plain = asked(spark, LIMITS).drop("low", "high")
    for name, value in (("max_drop", 60.0), ("max_step_drop", 150.0)):
        operator = ops.fuel_used_drops if name == "max_drop" else ops.clean_drop_rise
        single = operator(readings, plain, **{name: value}).collect()
        each = operator(readings, plain.withColumn(name, F.lit(value)), ).drop(name).collect()
        assert sorted(map(str, single)) == sorted(map(str, each))


def test_report_limits(spark, data):
    readings, _ = data
    plain = asked(spark, [40.0, 10.0, None]).withColumnsRenamed({"low": "perc_no_data", "high": "perc_need_cab"})
    got = {(r.eqmt_id, r.time_from, r.time_to): r.status for r in ops.shift_fuel_report(readings, plain).collect()}
    asked_for = {(r.eqmt, r.time_from, r.time_to): (r.perc_no_data, r.perc_need_cab) for r in plain.collect()}
    for a, b in {*asked_for.values()}:
        limits = {k: v for k, v in (("perc_no_data", a), ("perc_need_cab", b)) if v is not None}
        for r in ops.shift_fuel_report(readings, plain.drop("perc_no_data", "perc_need_cab"), **limits).collect():
            key = (r.eqmt_id, r.time_from, r.time_to)
            if asked_for[key] == (a, b):
                assert got[key] == r.status


def test_levels_off_the_grid_count_exactly(spark):
    """Stored levels may lie anywhere; the ends of an interval still cut between them."""
    rows = [("1", START + 1_000 * s, 100.0 - s, 101.0 - s) for s in range(0, 900, 50)]
    levels = spark.createDataFrame(rows, "eqmt string, ms long, a double, b double").select(
        F.timestamp_millis("ms").alias("timecreated"), "eqmt", F.col("a").cast("decimal(18,3)").alias("liters"), F.col("b").cast("decimal(18,3)").alias("liters_prev")
    )
    windows = windows_of(spark, [(1, "2024-01-01 00:00:50", "2024-01-01 00:08:20")]).withColumn("max_drop", F.lit(2.0))
    assert float(ops.fuel_used_drops(levels, windows).first().fuel_used) == 10.0


def test_no_request_is_joined_with_levels(spark, data):
    readings, _ = data
    requests = asked(spark, LIMITS).withColumnRenamed("high", "max_drop")
    plan = ops.fuel_used_drops(readings, requests, prune=False)._jdf.queryExecution().executedPlan().toString()
    # One join for the cut units, one that brings the answers back.
    assert plan.count("Join ") <= 2 and "NestedLoop" not in plan


def test_quality_by_shift_of_requests_equals_the_single_range(spark, data):
    from .conftest import shifts_of

    readings, _ = data
    shifts = shifts_of(spark, days=6)
    t0, t1 = START // 1000 + 1_234, START // 1000 + 2 * 86_400
    requests = spark.createDataFrame([(e, t0 + k, t1) for e in range(13) for k in (0, 40_000)], "eqmt int, t0 long, t1 long")
    got = ops.fuel_usage_quality_by_shift_requests(readings, requests, shifts).collect()
    for k in (0, 40_000):
        want = ops.fuel_usage_quality_by_shift(readings, shifts, t0 + k, t1).collect()
        mine = sorted(str((r.eqmt, r.shiftstart_epoch, r.fuel_used, r.status, r.accuracy)) for r in got if r.t0 == t0 + k)
        assert mine == sorted(str((r.eqmtid, r.shiftstart_epoch, r.fuel_used, r.status, r.accuracy)) for r in want) and mine


def test_an_interval_takes_few_blocks(spark):
    """Numbers, not moments, are cut: six blocks of a size at most, which tile the stretch; none where nothing changed."""
    from tankline.operators.limits import FAN, SIZES, _pieces

    stretches = [(0, 1), (0, 2), (3, 4), (1, 67), (0, 64), (5, 1_000), (7, 300_000), (262_143, 1_000_001), (5, 5), (0, 0)]
    pieces = spark.createDataFrame(stretches, "first long, stop long").select("*", _pieces(F.col("first"), F.col("stop"))).collect()
    for first, stop in stretches:
        own = sorted((r.block * FAN**r.k, (r.block + 1) * FAN**r.k) for r in pieces if (r.first, r.stop) == (first, stop))
        if first == stop:
            assert [b for _, b in own] == [0]  # before all numbers
        else:
            assert own[0][0] == first and own[-1][1] == stop and all(a[1] == b[0] for a, b in zip(own, own[1:]))
            assert len(own) <= 2 * (FAN - 1) * SIZES + stop // FAN**SIZES


def test_requests_are_not_cut_into_buckets(spark):
    """A request of a year with two readings meets days, not the 52,560 buckets of ten minutes."""
    readings = readings_of(spark, [(1, "2024-01-01 00:01:00", 500), (1, "2024-01-01 00:12:00", 480)])
    requests = spark.createDataFrame([(1, START // 1000, START // 1000 + 366 * 86_400)], "eqmt int, t0 long, t1 long")
    got = ops.fuel_usage_quality_requests(readings, requests, minutes=10, prune=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    cut = [line for line in plan.split("\n") if "explode(sequence(" in line]
    assert cut and all("86400000" in line and "600000)" not in line.replace("86400000", "") for line in cut), cut
    assert [(r.fuel_used, r.status) for r in got.collect()] == [(20.0, "Ok")]
