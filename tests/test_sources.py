import random
from datetime import date, datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tankline import operators as ops
from tankline.operators import profile
from tankline.sources import (
    calendar_of,
    drop_levels,
    materialize_levels,
    newest_readings,
    read_engine_hours,
    read_level_csv,
    read_levels,
    read_levels_for,
    read_readings,
    read_shifts,
    refresh_levels,
    store_readings,
    stored_levels,
    wide_calendar,
    write_level_csv,
)

from .conftest import ms, readings_of, shifts_of, windows_of

ROWS = [(31, "2024-01-01 09:10:00", 742), (31, "2024-01-01 09:15:00", 737.25),
        (7, "2024-01-02 23:59:59.999", 10.5)]


def test_readings_with_other_names(spark, tmp_path):
    df = readings_of(spark, ROWS)
    df.withColumnsRenamed({"time_created": "t", "liters": "v"}).write.parquet(f"{tmp_path}/r")
    back = read_readings(spark, f"{tmp_path}/r", {"time_created": "t", "liters": "v"})
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_both_calendar_shapes(spark, tmp_path):
    shifts_of(spark).write.parquet(f"{tmp_path}/narrow")
    wide_calendar(shifts_of(spark)).write.parquet(f"{tmp_path}/wide")
    assert len(read_shifts(spark, f"{tmp_path}/narrow").columns) == 4
    wide = read_shifts(spark, f"{tmp_path}/wide").orderBy("shiftstart").first()
    assert (wide.length, wide.shiftstart_epoch) == (43_200, ms("2023-12-31 20:45:00") // 1000)


def test_optional_calendar_columns_are_kept_on_their_own(spark, tmp_path):
    short = shifts_of(spark).withColumn("seconds", F.lit(28_800))
    short.write.parquet(f"{tmp_path}/short")
    read = read_shifts(spark, f"{tmp_path}/short", {"length": "seconds"})
    assert read.columns[-1] == "length" and {r.length for r in wide_calendar(read).collect()} == {28_800}


def test_calendar_labels(spark):
    shifts = calendar_of(readings_of(spark, ROWS)).orderBy("shiftstart").collect()
    assert shifts[0].shiftstart == datetime(2023, 12, 31, 20, 45)
    assert (shifts[0].shiftdate, shifts[0].shift) == (date(2024, 1, 1), 1)
    assert (shifts[1].shiftdate, shifts[1].shift) == (date(2024, 1, 1), 2)
    assert shifts[-1].shiftstart == datetime(2024, 1, 3, 8, 45)
    assert calendar_of(readings_of(spark, [])).count() == 0


def test_engine_hours_source(spark, tmp_path):
    df = spark.createDataFrame([(1000, 1, 5), (2999, 1, 0), (3000, 1, 6)], "time_created long, eqmt int, engrs int")
    df.write.parquet(f"{tmp_path}/e")
    assert read_engine_hours(spark, f"{tmp_path}/e").count() == 2
    assert read_engine_hours(spark, f"{tmp_path}/e", 1, 2).count() == 1


def test_level_csv(spark, tmp_path):
    text = '"timecreated","eqmt","liters","liters_prev"\n2024-07-04 16:05:00.000 +0500,"31",742.000,748.125\n'
    (tmp_path / "levels.csv").write_text(text)
    row = read_level_csv(spark, str(tmp_path / "levels.csv")).first()
    assert (row.eqmt, str(row.liters), str(row.liters_prev)) == ("31", "742.000", "748.125")
    zoneless = read_level_csv(spark, str(tmp_path / "levels.csv")).select(F.col("timecreated").cast("timestamp_ntz"))
    assert zoneless.first()[0] == datetime(2024, 7, 4, 11, 5)
    levels = ops.levels_5min(readings_of(spark, ROWS))
    write_level_csv(levels, f"{tmp_path}/out")
    back = read_level_csv(spark, f"{tmp_path}/out")
    assert sorted(back.collect(), key=str) == sorted(levels.collect(), key=str)


def test_stored_levels_prune_by_day(spark, tmp_path):
    levels = ops.levels_5min(readings_of(spark, ROWS))
    materialize_levels(levels, f"{tmp_path}/levels")
    assert sorted(read_levels(spark, f"{tmp_path}/levels").collect(), key=str) == sorted(levels.collect(), key=str)
    one = read_levels(spark, f"{tmp_path}/levels", "2024-01-02", "2024-01-02")
    assert [r.eqmt for r in one.collect()] == ["7"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_checks(spark):
    df = readings_of(spark, ROWS + [(7, "2024-01-02 00:00:00", None)])
    levels = ops.levels_5min(df)
    assert profile.bucket_count(df).first()[0] == 3
    assert profile.max_level(df).first()[0] == 742
    assert dict(profile.max_level_per_equipment(df).collect()) == {31: 742, 7: 10.5}
    assert [r.liters for r in profile.distinct_levels(df).collect()] == [742, 737.25, 10.5, None]
    assert [r.eqmt for r in profile.distinct_equipment(df).collect()] == [7, 31]
    assert profile.distinct_raw(df).count() == 1
    days = {r.eqmt: (r.first_day.day, r.last_day.day) for r in profile.day_span_of_readings(df).collect()}
    assert days == {31: (1, 1), 7: (2, 2)}
    assert {r.eqmt: r.last_day.day for r in profile.day_span_of_levels(levels).collect()} == {"31": 1, "7": 2}
    assert profile.time_span_of_levels(levels).first().row_count == 4
    assert profile.reading_count(df).first()[0] == 4
    window = ("2024-01-01 09:10:00", "2024-01-01 09:15:00")
    assert [r.eqmt for r in profile.levels_between(levels, *window, eqmt=31).collect()] == ["31", "31"]
    assert profile.levels_between(levels, *window, limit=1).count() == 1
    low, high = ms("2024-01-01 00:00:00") // 1000, ms("2024-01-03 00:00:00") // 1000
    assert profile.readings_between(df, low, high, eqmt=7).count() == 2
    assert profile.readings_between(df, low, high, eqmt=7, positive=True).count() == 1
    shifts = shifts_of(spark)
    assert profile.shift_listing(shifts, date_from="2024-01-02").count() == 3
    assert profile.shift_listing(shifts, date_of="2024-01-02").count() == 2
    down = profile.shift_listing(shifts, date_to="2024-01-02", descending=True).collect()
    assert [r.shift for r in down] == [2, 1, 2, 1]


def random_readings(spark, seed, machines=30):
    rng = random.Random(seed)
    rows = []
    for e in range(machines):
        t = ms("2024-01-01 00:00:00")
        for _ in range(rng.randint(0, 60)):
            t += rng.choice([60_000, 300_000, 7_200_000, 50_000_000])
            rows.append((e if e else None, t, rng.choice([None, 10.0, 20.5, rng.random() * 100])))
    return rows


def alike(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("days", [["2024-01-03"], ["2024-01-02", "2024-01-03", "2024-01-06"], ["2024-01-01"], ["2025-05-05"]])
def test_refreshed_days_equal_levels_made_anew(spark, tmp_path, days):
    """Changed, new and vanished readings; the first level after a changed day gets its new previous level."""
    before, path = random_readings(spark, 1), f"{tmp_path}/levels"
    day = lambda t: str(datetime.fromtimestamp(t / 1000, timezone.utc).date())
    other = [r for r in random_readings(spark, 2) if r[0] is None or r[0] % 4]  # whole machines are gone
    after = [r for r in before if day(r[1]) not in days] + [r for r in other if day(r[1]) in days]
    materialize_levels(ops.levels_5min(readings_of(spark, before)), path)
    kept = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    refresh_levels(readings_of(spark, after), path, days)
    want = ops.levels_5min(readings_of(spark, after))
    assert alike(read_levels(spark, path), want)
    untouched = [f for f in kept if f.exists() and f.stat().st_mtime_ns == kept[f]]
    assert untouched  # other partitions stay as they were


def test_a_day_without_readings_loses_its_partitions(spark, tmp_path):
    path, rows = f"{tmp_path}/levels", [(1, "2024-01-01 10:00:00", 5), (1, "2024-01-02 10:00:00", 6), (1, "2024-01-04 10:00:00", 7)]
    materialize_levels(ops.levels_5min(readings_of(spark, rows)), path)
    left = readings_of(spark, [rows[0], rows[2]])
    refresh_levels(left, path, ["2024-01-02"])
    assert alike(read_levels(spark, path), ops.levels_5min(left))
    assert not list(Path(path).glob("day=2024-01-02/*/*.parquet"))


def test_levels_are_dropped_after_use(spark, tmp_path):
    path, levels = f"{tmp_path}/levels", ops.levels_5min(readings_of(spark, ROWS))
    with stored_levels(levels, path) as found:
        assert alike(found, levels) and Path(path).exists()
    assert not Path(path).exists()
    with pytest.raises(ZeroDivisionError), stored_levels(levels, path):
        1 / 0
    assert not Path(path).exists()
    drop_levels(spark, path)


def test_requests_open_only_their_days_and_machines(spark, tmp_path):
    from .test_plans import _scanned

    path = f"{tmp_path}/levels"
    rows = [(e, ms(f"2024-01-{d:02} 12:00:00"), float(e)) for e in range(40) for d in range(1, 29)]
    levels = ops.levels_5min(readings_of(spark, rows))
    materialize_levels(levels, path)
    windows = windows_of(spark, [(3, "2024-01-05 00:00:00", "2024-01-06 23:00:00"), (3, "2024-01-07 00:00:00", "2024-01-07 23:00:00")])
    found = read_levels_for(spark, path, windows)
    report = ops.shift_fuel_report(found, windows, prune=False)
    assert alike(report, ops.shift_fuel_report(levels, windows)) and report.count() == 2
    assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().executedPlan().toString()
    assert max(_scanned(spark, found)) <= 3 * 40 / 4
    nothing = read_levels_for(spark, path, windows.limit(0))
    assert nothing.count() == 0


def test_newest_readings_come_from_the_footers(spark, tmp_path):
    from tankline.sources.files import _newest

    rows = [(e, t, x) for e, t, x in random_readings(spark, 4) if e is not None] + [(900, "2024-02-01 00:00:00", None)]
    readings, path = readings_of(spark, rows), f"{tmp_path}/r"
    store_readings(readings, path)
    assert alike(read_readings(spark, path), readings)
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    found = newest_readings(spark, path, f"{tmp_path}/newest")
    assert {k: spark.conf.get(k) for k in settings} == before
    want = readings.groupBy("eqmt").agg(F.max("time_created").alias("last_ms"))
    assert alike(found, want)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = _newest(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "PushedAggregation: [MAX(time_created)]" in plan and "PushedGroupBy: [eqmt]" in plan


@pytest.mark.parametrize("rule", ["next_or_last_reading", "next_by_number"])
def test_intervals_take_the_newest_readings_as_given(spark, tmp_path, rule):
    from .conftest import requests_of

    readings = readings_of(spark, [(1, "2024-01-03 10:00:00", 5), (2, "2024-01-01 10:00:00", 6)])
    requests = requests_of(spark, [(e, "2024-01-02", 1, "2024-01-03", 2) for e in (1, 2, 3)])
    store_readings(readings, f"{tmp_path}/r")
    newest = newest_readings(spark, f"{tmp_path}/r", f"{tmp_path}/newest")
    given = ops.resolve_interval(requests, shifts_of(spark), rule, newest=newest)
    assert alike(given, ops.resolve_interval(requests, shifts_of(spark), rule, readings=readings))
