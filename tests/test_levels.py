"""Operators on 5-minute levels and on bucket averages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tankline import operators as ops

from .conftest import ms, readings_of, shifts_of, windows_of

DAY = ("2024-01-01 00:00:00", "2024-01-02 00:00:00")


def series(levels, start="2024-01-01 01:00:00", eqmt=1, minutes=5):
    t = ms(start)
    return [(eqmt, t + i * minutes * 60_000, x) for i, x in enumerate(levels)]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_drop_edges(spark):
    # Falls of 199.999, 200 and 200.001, and a rise.
    df = readings_of(spark, series([1000, 800.001, 600.001, 400, 900]))
    window = windows_of(spark, [(1, *DAY)])
    assert float(one(ops.fuel_used_drops(df, window)).fuel_used) == 600.0
    assert float(one(ops.fuel_used_drops(df, window, max_drop=200)).fuel_used) == 200.0
    assert float(one(ops.clean_drop_rise(df, window)).total_used) == 400.0


def test_rise_edges(spark):
    rises = [150, 150.001, 200, 200.001]
    levels, x = [0], 0
    for r in rises:
        levels += [x + r, x]
    df = readings_of(spark, series(levels))
    got = one(ops.clean_drop_rise(df, windows_of(spark, [(1, *DAY)])))
    assert (float(got.total_refueled), got.valid_points, got.total_points) == (350.0, 5, 8)
    free = one(ops.clean_drop_rise(df, windows_of(spark, [(1, *DAY)]), cap_rises=False))
    assert float(free.total_refueled) == 550.0


def test_interval_ends(spark):
    """Both ends included for sums of falls, the last one excluded in the report."""
    df = readings_of(spark, series([100, 90, 70, 40]))
    window = windows_of(spark, [(1, "2024-01-01 01:05:00", "2024-01-01 01:15:00")])
    assert float(one(ops.fuel_used_drops(df, window)).fuel_used) == 60.0
    report = one(ops.shift_fuel_report(df, window))
    assert (float(report.fuel_used), report.valid_points, report.status) == (30.0, 2, "ok")
    # A window before the first level: that level has no previous one but counts.
    first = windows_of(spark, [(1, "2024-01-01 00:00:00", "2024-01-01 01:05:00")])
    report = one(ops.shift_fuel_report(df, first))
    assert (float(report.fuel_used), report.valid_points) == (0.0, 1)


def test_empty_intervals(spark):
    df = readings_of(spark, series([100, 90]))
    nothing = windows_of(spark, [(1, "2024-02-01 00:00:00", "2024-02-02 00:00:00"), (9, *DAY)])
    assert [float(r.fuel_used) for r in ops.fuel_used_drops(df, nothing).collect()] == [0.0, 0.0]
    assert {float(r.fuel_used) for r in ops.fuel_used_by_segment(df, nothing).collect()} == {0.0}
    assert {tuple(map(float, r[-4:])) for r in ops.clean_drop_rise(df, nothing).collect()} == {(0,) * 4}
    assert {r.fuel_used for r in ops.fuel_used_first_last(df, nothing).collect()} == {None}
    assert ops.shift_fuel_report(df, nothing).count() == 0


def test_report_status_edges(spark):
    # 10 points: exactly 80 % rises is not yet no_data, exactly 30 % leaps not yet calibration.
    up = [0, 1, 2, 3, 4, 5, 6, 7, 8, 3]
    leaps = [0, 15, 31, 47, 63, 60, 59, 58, 57, 56]
    more = [0, 16, 32, 48, 64, 60, 59, 58, 57, 56]
    rising = list(range(11))
    cases = {1: (up, "ok"), 2: (leaps, "ok"), 3: (more, "need calibration"), 4: (rising, "no_data")}
    rows = [r for e, (levels, _) in cases.items() for r in series(levels, eqmt=e)]
    windows = windows_of(spark, [(e, *DAY) for e in cases])
    got = {r.eqmt_id: r.status for r in ops.shift_fuel_report(readings_of(spark, rows), windows).collect()}
    assert got == {e: status for e, (_, status) in cases.items()}
    strict = ops.shift_fuel_report(readings_of(spark, rows), windows, perc_no_data=79).collect()
    assert {r.eqmt_id: r.status for r in strict}[1] == "no_data"


def test_report_for_all_shifts_equals_requests(spark):
    df = readings_of(
        spark, series([500 - 7 * (i % 13) for i in range(400)]) + series([5, 4], eqmt=2)
    )
    shifts = shifts_of(spark)
    everything = ops.shift_fuel_report_all(df, shifts)
    requests = shifts.select(
        F.explode(F.array(F.lit(1), F.lit(2))).alias("eqmt"),
        F.col("shiftdate").alias("startdate"),
        F.col("shift").alias("startshift"),
        F.col("shiftdate").alias("enddate"),
        F.col("shift").alias("endshift"),
    )
    asked = ops.shift_fuel_report(df, ops.resolve_interval(requests, shifts, "one_shift"))
    assert sorted(everything.collect()) == sorted(asked.collect())
    # Machine 1 reads for 33 hours 20 minutes: four shifts. Machine 2 in one.
    assert everything.count() == 5


def test_segments(spark):
    df = readings_of(spark, series([100, 90, 85, 240, 230, 400, 150, 140]))
    window = windows_of(spark, [(1, *DAY)])
    segments = ops.refuel_segments(df, window).orderBy("seg_no").collect()
    # 155 and 170 open segments; the fall of 250 is out of bounds.
    assert [(r.seg_no, float(r.seg_consumption)) for r in segments] == [(0, 15.0), (1, 10.0), (2, 10.0)]
    total = one(ops.fuel_used_by_segment(df, window))
    assert (float(total.fuel_used), total.segments) == (35.0, 3)


def test_first_last(spark):
    rows = [(1, "2024-01-01 01:00:00", 100), (1, "2024-01-01 01:09:59", 90),
            (1, "2024-01-01 02:00:00", 50), (1, "2024-01-01 02:10:00", 130),
            (1, "2024-01-01 02:10:00.001", 999)]
    window = windows_of(spark, [(1, "2024-01-01 01:00:00", "2024-01-01 02:10:00")])
    assert one(ops.fuel_used_first_last(readings_of(spark, rows), window)).fuel_used == -35.0


def test_overlapping_and_repeated_requests(spark):
    df = readings_of(spark, series(range(100, 0, -1)))
    rows = [(1, f"2024-01-01 0{h}:00:00", "2024-01-01 09:00:00") for h in range(1, 9)] * 3
    got = ops.fuel_used_drops(df, windows_of(spark, rows)).collect()
    assert len(got) == 24
    expected = {h: 96.0 - 12 * (h - 1) + (1 if h > 1 else 0) for h in range(1, 9)}
    assert {r.time_from.hour: float(r.fuel_used) for r in got} == expected


def quality(spark, levels, **more):
    df = readings_of(spark, series(levels, "2024-01-01 00:00:00", minutes=20))
    first = ms("2024-01-01 00:00:00") // 1000
    return ops.fuel_usage_quality(df, first, first + 86_399, **more).collect()


def test_quality_statuses(spark):
    ok = quality(spark, [500, 440, 430, 430, 700])[0]
    assert (ok.eqmtid, ok.fuel_used, ok.status, float(ok.accuracy)) == ("1", 70.0, "Ok", 0.0)
    # Falls of exactly 70 and rises from 250 on count nowhere.
    edge = quality(spark, [500, 430, 680, 610])[0]
    assert (edge.fuel_used, edge.status) == (0.0, "Ok")
    jumpy = quality(spark, [500, 429, 600, 590])[0]
    assert (jumpy.fuel_used, jumpy.status, float(jumpy.accuracy)) == (None, "need calibration", 66.7)
    flat = quality(spark, [5] * 7)[0]
    assert (flat.fuel_used, flat.status, flat.accuracy) == (None, "no_data", None)
    assert quality(spark, [5]) == [] and quality(spark, [0, 5, 0]) == []


def test_loose_preset_never_counts_rises(spark):
    got = quality(spark, [100, 140, 300, 290], limits=ops.LOOSE_LIMITS)[0]
    assert (got.fuel_used, got.status) == (10.0, "Ok")


def test_quality_by_shift_edges(spark):
    rows = series([100, 90, 80, 70], "2024-01-01 08:25:00", minutes=10) + [
        (1, "2024-03-01 00:00:00", 60), (1, "2024-03-01 00:10:00", 55)]
    df = readings_of(spark, rows)
    got = ops.fuel_usage_quality_by_shift(df, shifts_of(spark), 0, 2_000_000_000)
    used = {r.shiftstart_epoch: r.fuel_used for r in got.collect()}
    # Buckets at 08:20, 08:30, 08:40, 08:50; none on the edge itself.
    night, day = ms("2023-12-31 20:45:00") // 1000, ms("2024-01-01 08:45:00") // 1000
    assert used == {night: 20.0, day: 10.0, None: 15.0}
    custom = shifts_of(spark).withColumn("shiftstart", F.col("shiftstart") + F.expr("interval 5 minutes"))
    twice = ops.fuel_usage_quality_by_shift(df, custom, 0, 2_000_000_000)
    used = {r.shiftstart_epoch: r.fuel_used for r in twice.collect()}
    # The bucket at 08:50 now lies on the edge of both shifts.
    assert used[night + 300] == 30.0 and used[day + 300] == 10.0


@pytest.mark.parametrize("form,expected", [("delta", -1.3), ("fall", 1.25), ("change", -1.25)])
def test_traces(spark, form, expected):
    levels = ops.levels_5min(readings_of(spark, series([10, 8.75])))
    last = ops.level_trace(levels, form, eqmt=1).collect()[-1]
    assert float(last[4]) == expected
    if form == "change":
        assert float(last.fuel_used) == 1.25
    assert ops.level_trace(levels, form, limit=1).count() == 1
    assert ops.level_trace(levels, form, time_from="2024-01-01 01:05:00").count() == 1
    assert ops.level_trace(levels, form, eqmt=3).count() == 0
    assert last.timecreated == datetime(2024, 1, 1, 1, 5)


def test_stored_levels_serve_instead_of_readings(spark, tmp_path):
    from tankline.sources import materialize_levels, read_levels

    df = readings_of(spark, series([100, 90, 250, 240, 20, 19, 400, 300] * 9))
    materialize_levels(ops.levels_5min(df), f"{tmp_path}/levels")
    stored = read_levels(spark, f"{tmp_path}/levels")
    windows = windows_of(
        spark, [(1, "2024-01-01 01:25:00", "2024-01-01 03:00:00"), (1, *DAY), (2, *DAY)]
    )
    for method in (
        ops.fuel_used_drops, ops.fuel_used_by_segment, ops.clean_drop_rise, ops.shift_fuel_report
    ):
        want = sorted(method(df, windows).collect())
        assert sorted(method(stored, windows).collect()) == want
        assert sorted(method(stored, windows, prune=False).collect()) == want
    shifts = shifts_of(spark)
    assert sorted(ops.shift_fuel_report_all(stored, shifts).collect()) == sorted(
        ops.shift_fuel_report_all(df, shifts).collect()
    )
