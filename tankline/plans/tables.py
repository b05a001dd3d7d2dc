"""The operators' input tables, derived by Spark from the given ``events``."""

from __future__ import annotations

import uuid

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, TimestampType

from ..sources import calendar_of, wide_calendar

# The request windows (start date, start shift, end date, end shift)
# put to every machine. Overlapping, one-shift, reversed, last-shift and unknown
# shifts are all among them.
WINDOWS = (
    ("2024-01-01", 1, "2024-01-10", 2),
    ("2024-01-08", 2, "2024-01-20", 1),
    ("2024-01-21", 1, "2024-01-30", 2),
    ("2024-01-12", 1, "2024-01-12", 1),
    ("2024-01-15", 2, "2024-01-15", 1),
    ("2024-01-20", 1, "2024-01-31", 2),
    ("2024-01-18", 1, "2024-03-05", 2),
    ("2024-03-01", 1, "2024-03-02", 2),
    ("2024-01-25", 1, "2024-01-05", 2),
    ("2024-01-06", 2, "2024-01-11", None),
)

# Days whose readings come late; the first two are neighbours.
LATE_DAYS = ("2024-01-10", "2024-01-11", "2024-01-20")

# Epoch seconds: all of January 2024 and ten days inside it.
MONTH = (1_704_067_200, 1_706_745_599)
TEN_DAYS = (1_704_844_800, 1_705_708_800)


# Limits of single requests, as SQL that both engines read; where one is NULL the usual limit counts.
DROP_LIMITS = {"max_drop": "CASE WHEN eqmt % 5 <> 0 THEN CAST(20 + eqmt % 7 * 30 AS DOUBLE) END"}
CLEAN_LIMITS = {
    "refuel_threshold": "CASE WHEN eqmt % 4 <> 0 THEN CAST(eqmt % 6 * 25 AS DOUBLE) END",
    "max_step_drop": "CASE WHEN eqmt % 3 <> 0 THEN CAST(40 + startshift * 30 AS DOUBLE) END",
}
REPORT_LIMITS = {
    "perc_no_data": "CASE WHEN eqmt % 3 <> 0 THEN CAST(40 + eqmt % 4 * 5 AS DOUBLE) END",
    "perc_need_cab": "CASE WHEN eqmt % 5 <> 0 THEN CAST(20 + eqmt % 3 * 10 AS DOUBLE) END",
}

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The schema is given: inferring it would cost a job for every use.
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def readings(spark: SparkSession, sf_dir: str, within: tuple[int, int] | None = None) -> DataFrame:
    """``within`` (epoch seconds) bounds the stored time itself, so that the scan can skip the rest."""
    stored = events(spark, sf_dir)
    if within is not None:
        at = [F.lit(datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz") for s in (within[0], within[1] + 1)]
        stored = stored.filter((F.col("ts") >= at[0]) & (F.col("ts") <= at[1]))
    return stored.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_created"),
        F.col("user_id").cast("int").alias("eqmt"),
        F.col("props").alias("raw"),
        F.col("value").alias("liters"),
    )


def edge_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings with unknown levels, copies and tied times among them."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    number = F.col("event_id")
    copies = F.when(number % 13 == 0, 3).when(number % 7 == 0, 2).otherwise(1)
    return events(spark, sf_dir).select(
        F.when(number % 11 < 5, at - F.pmod(at, F.lit(14_400_000))).otherwise(at).alias("time_created"),
        F.col("user_id").cast("int").alias("eqmt"),
        F.col("props").alias("raw"),
        F.when(number % 17 != 0, F.col("value")).alias("liters"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_of(readings(spark, sf_dir))


def shifts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_calendar(shifts(spark, sf_dir))


def engine_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slowly rising meter; sign-ups stand for mistyped entries."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    hours = (ms - F.lit(MONTH[0] * 1000)) / F.lit(3_600_000.0)
    typo = F.when(F.col("event_type") == "signup", 50).otherwise(0)
    return events(spark, sf_dir).select(
        ms.alias("time_created"),
        F.col("user_id").cast("int").alias("eqmt"),
        (1000 + F.floor(hours * 0.6) + typo).cast("int").alias("engrs"),
    )


def idle_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error stands for an hour of breakdown, every click for one of use."""
    at = F.col("ts").cast("timestamp")
    used = events(spark, sf_dir).filter(F.col("event_type").isin("error", "click"))
    return used.select(
        F.col("user_id").cast("int").alias("eqmt"),
        F.when(F.col("event_type") == "error", 1).otherwise(2).alias("status"),
        at.alias("t0"),
        (at + F.expr("interval 1 hour")).alias("t1"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine with every window."""
    windows = F.array(
        *[
            F.struct(
                F.lit(a).cast("date").alias("startdate"),
                F.lit(b).alias("startshift"),
                F.lit(c).cast("date").alias("enddate"),
                F.lit(d).cast("int").alias("endshift"),
            )
            for a, b, c, d in WINDOWS
        ]
    )
    machines = readings(spark, sf_dir).select("eqmt").distinct()
    return machines.select("eqmt", F.inline(windows))


def second_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = F.array(
        *[
            F.struct(F.lit(a).cast("long").alias("t0"), F.lit(b).cast("long").alias("t1"))
            for a, b in (MONTH, TEN_DAYS)
        ]
    )
    machines = readings(spark, sf_dir).select("eqmt").distinct()
    return machines.select("eqmt", F.inline(windows))


def run_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def plain(df: DataFrame) -> DataFrame:
    """Types that both engines print alike: doubles to six places, zoneless times.

    Doubles go through ten places, so that binary noise cannot tip a tie.
    """

    def column(field):
        c = F.col(field.name)
        if isinstance(field.dataType, (DoubleType, DecimalType)):
            c = F.round(c.cast("decimal(30,10)"), 6).cast("double")
        elif isinstance(field.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(field.dataType, DateType):
            c = c.cast("date")
        return c.alias(field.name)

    return df.select(*[column(f) for f in df.schema])
