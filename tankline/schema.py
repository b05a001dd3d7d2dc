"""Table layouts the operators expect."""

from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

READINGS = StructType(
    [
        StructField("time_created", LongType()),  # epoch milliseconds
        StructField("eqmt", IntegerType()),
        StructField("raw", StringType()),
        StructField("liters", DoubleType()),
    ]
)

SHIFTS = StructType(
    [
        StructField("shiftstart", TimestampNTZType(), False),
        StructField("shiftdate", DateType()),
        StructField("shift", IntegerType()),
        StructField("crew", IntegerType()),
    ]
)

SHIFTS_WIDE = StructType(
    SHIFTS.fields
    + [
        StructField("length", IntegerType()),  # seconds
        StructField("shiftstart_epoch", LongType()),
    ]
)

ENGINE_HOURS = StructType(
    [
        StructField("time_created", LongType()),
        StructField("eqmt", IntegerType()),
        StructField("engrs", IntegerType()),
    ]
)

IDLE_INTERVALS = StructType(
    [
        StructField("eqmt", IntegerType()),
        StructField("status", IntegerType()),
        StructField("t0", TimestampType()),
        StructField("t1", TimestampType()),
    ]
)

LEVELS = StructType(
    [
        StructField("timecreated", TimestampType()),
        StructField("eqmt", StringType()),
        StructField("liters", DecimalType(18, 3)),
        StructField("liters_prev", DecimalType(18, 3)),
    ]
)

REQUESTS = StructType(
    [
        StructField("eqmt", IntegerType()),
        StructField("startdate", DateType()),
        StructField("startshift", IntegerType()),
        StructField("enddate", DateType()),
        StructField("endshift", IntegerType()),
    ]
)
