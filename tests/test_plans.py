"""What the physical plans must and must not contain."""

from tankline import operators as ops
from tankline.sources import read_readings

from .conftest import ms, readings_of, windows_of

def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_reaches_the_scan(spark, tmp_path):
    readings_of(spark, [(1, "2024-01-01 00:00:00", 1)]).write.parquet(f"{tmp_path}/r")
    readings = read_readings(spark, f"{tmp_path}/r")
    plan = plan_of(ops.fuel_usage_quality(readings, 1_704_067_200, 1_704_070_000))
    assert "GreaterThanOrEqual(time_created,1704067200000)" in plan
    assert "LessThanOrEqual(time_created,1704070000999)" in plan
    assert "raw" not in plan.split("ReadSchema")[1]


def _scanned(spark, df) -> list[int]:
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            yield node.metrics().apply("numOutputRows").value()
        if name.startswith("AdaptiveSparkPlan"):
            yield from walk(node.executedPlan())
        elif "QueryStage" in name:
            yield from walk(node.plan())
        else:
            for i in range(node.children().size()):
                yield from walk(node.children().apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_requests_prune_the_scan(spark, tmp_path):
    """Bounds found from the requests skip Parquet row groups when the query runs."""
    t = ms("2024-01-01 00:00:00")
    rows = spark.range(0, 400_000, 1, 1).selectExpr(
        f"{t} + id * 1000 AS time_created", "1 AS eqmt", "'' AS raw", "double(id % 977) AS liters"
    )
    rows.write.option("parquet.block.size", 1 << 18).parquet(f"{tmp_path}/r")
    readings = read_readings(spark, f"{tmp_path}/r")
    window = windows_of(spark, [(1, "2024-01-02 00:00:00", "2024-01-02 01:00:00")])
    pruned = ops.fuel_used_raw_drops(readings, window)
    whole = ops.fuel_used_raw_drops(readings, window, prune=False)
    assert pruned.collect() == whole.collect()
    assert max(_scanned(spark, whole)) == 400_000
    assert max(_scanned(spark, pruned)) < 100_000


def test_raw_rows_are_read_once_and_meet_no_request(spark, tmp_path):
    """U10-U12 and U4 sort rows and the requests' ends together: one scan of the readings, no join with them."""
    readings_of(spark, [(1, "2024-01-01 00:00:00", 1)]).write.parquet(f"{tmp_path}/r")
    readings = read_readings(spark, f"{tmp_path}/r")
    windows = windows_of(spark, [(1, "2024-01-01 00:00:00", "2024-01-02 00:00:00")])
    for operator in (ops.fuel_level_difference, ops.fuel_used_raw_drops, ops.analyze_fuel, ops.fuel_used_first_last):
        plan = plan_of(operator(readings, windows, prune=False))
        assert plan.count("FileScan parquet") == 1, operator.__name__
        assert plan.count("Join") <= 2, operator.__name__  # answers back to requests
    plan = plan_of(ops.fuel_between_confirmed_refills(readings, windows, prune=False))
    # Once for the units that all share, once for the cut ones; by unit, by block and by request.
    assert plan.count("FileScan parquet") == 2


def test_idle_time_and_segments_join_no_request_with_rows(spark):
    from pyspark.sql import functions as F

    idle = spark.createDataFrame([], "eqmt int, status int, t0 timestamp, t1 timestamp")
    asked = spark.createDataFrame([(1, 0, 10)], "eqmt int, t0 long, t1 long")
    assert "Join" not in plan_of(ops.idle_seconds(asked, idle))
    readings = readings_of(spark, [(1, "2024-01-01 00:00:00", 1)])
    windows = windows_of(spark, [(1, "2024-01-01 00:00:00", "2024-01-02 00:00:00")])
    segments = ops.refuel_segments(readings, windows, prune=False)
    # One join, with the machine's own segments, a row each.
    assert plan_of(segments.filter(F.lit(True))).count("Join ") <= 1
