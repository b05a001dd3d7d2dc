import os
import sys
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ms(text: str) -> int:
    """Epoch milliseconds of a UTC wall-clock time."""
    at = datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def readings_of(spark, rows):
    """Rows of (eqmt, time or epoch ms, liters)."""
    data = [
        (ms(t) if isinstance(t, str) else t, e, None, None if x is None else float(x))
        for e, t, x in rows
    ]
    from tankline.schema import READINGS

    return spark.createDataFrame(data, READINGS)


def shifts_of(spark, first="2024-01-01", days=3):
    """Two shifts a day: 20:45 of the evening before, and 08:45."""
    from tankline.schema import SHIFTS

    start = date.fromisoformat(first)
    rows = []
    for i in range(days):
        d = start + timedelta(days=i)
        midnight = datetime(d.year, d.month, d.day)
        rows.append((midnight - timedelta(hours=3, minutes=15), d, 1, None))
        rows.append((midnight + timedelta(hours=8, minutes=45), d, 2, None))
    return spark.createDataFrame(rows, SHIFTS)


def requests_of(spark, rows):
    from tankline.schema import REQUESTS

    data = [(e, date.fromisoformat(a), b, date.fromisoformat(c), d) for e, a, b, c, d in rows]
    return spark.createDataFrame(data, REQUESTS)


def windows_of(spark, rows):
    """Intervals given by their own zoneless times: (eqmt, from, to)."""
    from tankline.operators import interval_of_times

    data = [(e, datetime.fromisoformat(a), datetime.fromisoformat(b)) for e, a, b in rows]
    asked = spark.createDataFrame(
        data, "eqmt int, time_from timestamp_ntz, time_to timestamp_ntz"
    )
    return interval_of_times(asked)
