"""Readers and writers for the stored tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..functions import DAY_MS, epoch_second_range

LEVEL_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS Z"


def _mapped(df: DataFrame, layout: StructType, columns: Mapping[str, str] | None) -> DataFrame:
    columns = columns or {}
    return df.select(
        *[F.col(columns.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in layout]
    )


def read_readings(
    spark: SparkSession, path: str, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Raw level readings. ``columns`` maps our names to the file's names."""
    return _mapped(spark.read.parquet(path), schema.READINGS, columns)


def read_shifts(
    spark: SparkSession, path: str, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Shift calendar; ``length`` and ``shiftstart_epoch`` are kept where the file has them."""
    df, names = spark.read.parquet(path), columns or {}
    kept = [
        f
        for f in schema.SHIFTS_WIDE
        if f.name in schema.SHIFTS.names or names.get(f.name, f.name) in df.columns
    ]
    return _mapped(df, StructType(kept), columns)


def read_engine_hours(
    spark: SparkSession,
    path: str,
    begin: int | None = None,
    end: int | None = None,
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Meter entries above zero, optionally within an epoch-second range."""
    return engine_hour_entries(
        _mapped(spark.read.parquet(path), schema.ENGINE_HOURS, columns), begin, end
    )


def engine_hour_entries(
    entries: DataFrame, begin: int | None = None, end: int | None = None
) -> DataFrame:
    kept = entries.filter(F.col("engrs") > 0)
    if begin is not None and end is not None:
        kept = kept.filter(epoch_second_range("time_created", begin, end))
    return kept


def read_level_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exported levels: quoted CSV with a header and zoned times."""
    return spark.read.csv(
        path, header=True, schema=schema.LEVELS, timestampFormat=LEVEL_TIME_FORMAT
    )


def write_level_csv(levels: DataFrame, path: str) -> None:
    """The export that ``read_level_csv`` reads. Fails if ``path`` exists."""
    levels.write.mode("error").csv(path, header=True, timestampFormat=LEVEL_TIME_FORMAT)


#: Machines are dealt into so many folders a day.
MACHINE_PARTS = 16


def machine_part(eqmt: Column) -> Column:
    """The part of the stored levels in which a machine lies."""
    return F.pmod(F.xxhash64(eqmt.cast("string")), F.lit(MACHINE_PARTS)).cast("int")


def _write_levels(levels: DataFrame, path: str, mode: str) -> None:
    keys = ["day", "machine_part"]
    (
        levels.withColumns({"day": F.to_date("timecreated"), "machine_part": machine_part(F.col("eqmt"))})
        .repartition(*keys)
        .sortWithinPartitions(*keys, "eqmt", "timecreated")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def materialize_levels(levels: DataFrame, path: str) -> None:
    """Store levels as Parquet by day and part of the machines, sorted by machine and time.

    A day is written by many tasks, and readers skip the days and parts that they do not need. Give
    every run a path of its own: it fails if the path exists.
    """
    _write_levels(levels, path, "error")


def read_levels(
    spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """Stored levels; day bounds prune whole partitions."""
    df = spark.read.parquet(path)
    if first_day is not None:
        df = df.filter(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        df = df.filter(F.col("day") <= F.lit(last_day).cast("date"))
    return _mapped(df, schema.LEVELS, None)


def read_levels_for(spark: SparkSession, path: str, intervals: DataFrame) -> DataFrame:
    """Stored levels of the days and machine parts that the usable ``intervals`` touch; the others are not opened.

    The bounds are found when the query runs: first and last day, and the parts as bits of one number. As scalars they
    prune the partitions of the scan, whatever the number of requests. Give the result to an operator in place of readings.
    """
    usable = (F.col("bounds_status") == "ok") & (F.col("from_ms") <= F.col("to_ms")) & F.col("eqmt").isNotNull()
    asked = intervals.filter(usable)
    bit = F.call_function("shiftleft", F.lit(1), machine_part(F.col("eqmt")))
    parts = asked.select(F.bit_or(bit).alias("parts")).scalar()
    day = lambda ms: F.to_date(F.timestamp_millis(ms))
    first, last = asked.select(F.min(day("from_ms"))).scalar(), asked.select(F.max(day("to_ms"))).scalar()
    wanted = F.call_function("shiftright", parts, F.col("machine_part")).bitwiseAND(F.lit(1)) == 1
    df = spark.read.parquet(path).filter((F.col("day") >= first) & (F.col("day") <= last) & wanted)
    return _mapped(df, schema.LEVELS, None)


def refresh_levels(readings: DataFrame, path: str, days: Sequence[str]) -> None:
    """Make the stored levels of some ``days`` anew from ``readings``; the others stay as they are.

    A day's levels need only its own readings, but the first level of each machine after a changed day has its previous
    level there. So from what stays, the last level before and the first one after each changed stretch are looked up, in one
    partial aggregate, and the partitions of the latter are written again with it. Only these partitions and the changed days are
    replaced, each at once when the job commits. A day that has no readings any more loses its partitions.
    """
    from ..operators.resample import levels_5min

    spark = readings.sparkSession
    changed = F.col("day").isin([F.lit(d).cast("date") for d in days])
    at = F.col("time_created")
    midnight = lambda d, plus=0: F.unix_millis(F.date_add(F.lit(d).cast("date"), plus).cast("timestamp"))
    within = [(at >= midnight(d)) & (at < midnight(d, 1)) for d in days]
    own = readings.filter(reduce(lambda a, b: a | b, within, F.lit(False)))
    columns = [f.name for f in schema.LEVELS.fields]
    fresh = levels_5min(own).withColumn("day", F.to_date("timecreated")).filter(changed)

    stored = spark.read.parquet(path)
    kept = stored.filter(~changed)
    # Between two changed days lies one stretch that stays.
    stretch = sum((F.when(F.col("day") > F.lit(d).cast("date"), 1).otherwise(0) for d in set(days)), F.lit(0))
    level = F.struct("timecreated", "liters", "machine_part")
    ends = kept.groupBy("eqmt", stretch.alias("stretch")).agg(F.min(level).alias("first"), F.max(level).alias("last"))
    edge = F.array(F.struct("first.*", (F.col("stretch") > 0).alias("after")), F.struct("last.*", F.lit(False).alias("after")))
    edges = ends.select("eqmt", F.inline(edge)).groupBy("eqmt", "timecreated", "liters", "machine_part").agg(F.max("after").alias("after"))
    both = fresh.select("eqmt", "timecreated", "liters", F.lit(True).alias("fresh")).unionByName(edges, allowMissingColumns=True)
    before = F.lag("liters").over(Window.partitionBy("eqmt").orderBy("timecreated"))
    both = both.withColumn("liters_prev", before).filter("fresh OR after")

    mended = both.filter("after").select("eqmt", "timecreated", F.to_date("timecreated").alias("day"), "machine_part", F.col("liters_prev").alias("mended"))
    folders = mended.select("day", "machine_part").distinct()
    alike = kept["day"].eqNullSafe(folders["day"]) & kept["machine_part"].eqNullSafe(folders["machine_part"])
    again = kept.join(folders, alike, "left_semi")
    mended = mended.select(F.col("eqmt").alias("machine"), F.col("timecreated").alias("time"), "mended", F.lit(True).alias("met"))
    again = again.join(mended, F.col("eqmt").eqNullSafe(F.col("machine")) & (F.col("timecreated") == F.col("time")), "left")
    again = again.withColumn("liters_prev", F.when(F.col("met"), F.col("mended")).otherwise(F.col("liters_prev")))
    gone = stored.filter(changed).select("day", "machine_part").distinct()
    there = fresh.select("day", machine_part(F.col("eqmt")).alias("machine_part")).distinct()
    gone = gone.join(there, ["day", "machine_part"], "left_anti").collect()
    _write_levels(both.filter("fresh").select(*columns).unionByName(again.select(*columns)), path, "overwrite")
    for row in gone:  # at most the parts of the changed days
        _delete(spark, f"{path}/day={row['day']}/machine_part={row['machine_part']}")
    spark.catalog.refreshByPath(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_levels(spark: SparkSession, path: str) -> None:
    """Remove stored levels; nothing happens if there are none."""
    _delete(spark, path)


@contextmanager
def stored_levels(levels: DataFrame, path: str) -> Iterator[DataFrame]:
    """Levels stored for the time of a ``with`` block, and dropped after it, also on an error."""
    try:
        materialize_levels(levels, path)
        yield read_levels(levels.sparkSession, path)
    finally:
        drop_levels(levels.sparkSession, path)


def store_readings(readings: DataFrame, path: str) -> None:
    """Store readings as Parquet by machine, in order of time; ``read_readings`` reads them. Fails if the path exists."""
    columns = [f.name for f in schema.READINGS.fields]
    # A machine's readings are spread over tasks, so that no task writes a third of all.
    day = F.call_function("div", F.col("time_created"), F.lit(DAY_MS))
    (
        readings.select(*columns)
        .repartition("eqmt", F.pmod(day, F.lit(MACHINE_PARTS)))
        .sortWithinPartitions("eqmt", "time_created")
        .write.mode("error")
        .partitionBy("eqmt")
        .parquet(path)
    )


def newest_readings(spark: SparkSession, path: str, into: str) -> DataFrame:
    """``eqmt, last_ms``: the newest reading per machine of stored readings, a table that this call writes to ``into``.

    Machines are folders and the newest time of a file stands in its footer, so no reading is read: Spark is asked to
    push the aggregate down, for this job only.
    """
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # Partitions come as text or numbers by their look; the machine's own type is set afterwards.
        found = _newest(spark, path)
        rows = found.select(F.col("eqmt").cast(schema.READINGS["eqmt"].dataType).alias("eqmt"), "last_ms")
        rows.write.mode("error").csv(into)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.csv(into, schema="eqmt int, last_ms long")


def _newest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("eqmt").agg(F.max("time_created").alias("last_ms"))
