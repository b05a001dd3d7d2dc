"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the five controls 0x09-0x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tell_workers(spark: SparkSession) -> None:
    """Tells Python workers where this library lies, whatever folder the driver started in.

    On several machines the library must be installed at that place, or be sent with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    tell_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def words_of(text: Column) -> Column:
    """The words of a text, in order: longest runs without white space. NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+"), "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves that remainder; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus)) == remainder


def in_sample(share: float, seed: str, *columns: str) -> Column:
    """True for about that share of all rows, by a 64-bit hash of some columns; small shares draw in proportion too."""
    limit = int(min(max(share, 0.0), 1.0) * 2**64) - 2**63 - 1
    return F.lit(False) if limit < -(2**63) else F.xxhash64(F.lit(seed), *columns) <= F.lit(limit).cast("long")


def barrier(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as stored values.

    The optimizer copies a computed column into each place that uses it, also into lambdas
    that run once per array element. It does not look through a generator.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(packed)))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see: below spark.checkpoint.dir, else below the warehouse."""
    tell_workers(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, *partition_by: str) -> DataFrame:
    """Writes a table below the shared folder and reads it back, which also cuts the lineage."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def map_rows(df: DataFrame, fields: str, make: Callable[..., tuple[list, ...]], rows: int = 512) -> DataFrame:
    """``make`` turns lists of column values, ``rows`` at a time, into lists of the columns of ``fields``."""
    tell_workers(df.sparkSession)
    schema = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, fields.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = make(*batch.slice(at, rows).to_pydict().values())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, fields)
