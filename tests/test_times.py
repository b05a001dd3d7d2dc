from pyspark.sql import functions as F

from tankline import functions as fn
from tankline import operators as ops

from .conftest import ms, readings_of


def _hhmm(df, column):
    return [r[0] for r in df.select(F.date_format(column, "HH:mm")).collect()]


def test_twenty_minute_labels(spark):
    times = ["10:02:15", "10:09:48", "10:21:04", "10:37:10", "10:41:55", "10:58:09", "11:03:02"]
    df = readings_of(spark, [(1, f"2024-01-01 {t}", 1) for t in times]).coalesce(1)
    bucket = fn.time_bucket(fn.epoch_ms_to_ts("time_created", exact=False), 20)
    assert _hhmm(df, bucket) == ["10:00", "10:00", "10:20", "10:20", "10:40", "10:40", "11:00"]


def test_modulo_form_is_the_same_bucket(spark):
    df = readings_of(spark, [(1, ms("2024-01-01 00:00:00") + i * 97_013, 1) for i in range(500)])
    at = fn.epoch_ms_to_ts("time_created")
    same = fn.time_bucket(at, 10) == fn.time_bucket_modulo(at, 10)
    assert df.filter(~same).count() == 0


def test_last_bucket_of_the_hour_may_be_short(spark):
    df = readings_of(spark, [(1, "2024-01-01 10:55:00", 1), (1, "2024-01-01 11:05:00", 1)]).coalesce(1)
    assert _hhmm(df, fn.time_bucket(fn.epoch_ms_to_ts("time_created"), 25)) == ["10:50", "11:00"]


def test_range_keeps_the_last_second_whole(spark):
    end = ms("2024-01-01 00:00:10") // 1000
    df = readings_of(spark, [(1, end * 1000 + d, 1) for d in (-10_001, -10_000, 0, 999, 1000)])
    kept = ops.range_filter(df, end - 10, end).select("time_created").collect()
    assert sorted(r[0] - end * 1000 for r in kept) == [-10_000, 0, 999]


def test_range_truncates_toward_zero(spark):
    df = readings_of(spark, [(1, t, 1) for t in (-1000, -999, -1, 0, 999, 1000)])
    for a, b in ((0, 0), (-1, 0), (-1, -1), (0, 1)):
        kept = {r[0] for r in ops.range_filter(df, a, b).select("time_created").collect()}
        assert kept == {t for t in (-1000, -999, -1, 0, 999, 1000) if a <= int(t / 1000) <= b}


def test_fast_buckets_follow_the_session_zone(spark):
    """Epoch arithmetic and the zoned form agree in a zone of 5 hours 45 minutes."""
    rows = [(1, ms("2024-01-01 00:00:00") + i * 61_007, i) for i in range(300)]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    try:
        df = readings_of(spark, rows)
        slow = df.groupBy(
            fn.time_bucket(fn.epoch_ms_to_ts("time_created", exact=False), 5).alias("tm"), "eqmt"
        ).agg(F.avg("liters").alias("fuel"))
        fast = ops.resample_avg(df, 5)
        assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_wall_clock_in_a_zone(spark):
    row = spark.range(1).select(
        fn.wall_clock_ms(F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"), "Etc/GMT-5").alias("z"),
        fn.wall_clock_ms(F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"), "UTC").alias("u"),
        fn.wall_clock_ms(F.lit("2024-01-01 05:00:00").cast("timestamp_ntz")).alias("s"),
    ).first()
    assert row.z == ms("2024-01-01 00:00:00") and row.u == row.s == ms("2024-01-01 05:00:00")


def test_levels_round_half_away_and_keep_gaps(spark):
    rows = [(7, "2024-01-01 00:00:00", 10.0), (7, "2024-01-01 00:01:00", 10.0),
            (7, "2024-01-01 00:02:00", 10.0), (7, "2024-01-01 00:04:59.999", 10.01),
            (7, "2024-01-01 03:00:00", None), (7, "2024-01-01 04:00:00", 5)]
    got = ops.levels_5min(readings_of(spark, rows)).orderBy("timecreated").collect()
    assert [(str(r.liters), str(r.liters_prev)) for r in got] == [
        ("10.003", "None"), ("None", "10.003"), ("5.000", "None")]
    assert got[0].eqmt == "7"


def test_previous_level_depends_on_where_the_range_is_cut(spark):
    df = readings_of(spark, [(1, "2024-01-01 00:00:00", 3), (1, "2024-01-01 01:00:00", 2)])
    second = ms("2024-01-01 01:00:00") // 1000
    cut = ops.levels_5min_ranged(df, (second, second)).collect()
    assert [r.fuel_prev for r in cut] == [None]
    whole = ops.levels_5min(df).filter(F.col("liters") == 2).first()
    assert float(whole.liters_prev) == 3.0
