"""Sums of changes below a limit that every request may set for itself, without joining requests with levels.

How much of a machine's falls lies in an interval and below a limit is a question with two dimensions, time and size. The moments at which
a machine's level changes are numbered, and the numbers cut into blocks of one, four, 16, ... up to 4**9: a change stands in ten blocks, an
interval consists of at most six of each size, and of none where nothing changed. Within a block, the changes and the limits that are put to
it are sorted by size together, and a running total answers each limit. So the work is ten times the changes plus, per request, a number of rows that
grows with the logarithm of the moments that it holds, whatever their number and overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import SPAN

#: Blocks that make one of the next size, and the number of sizes above one.
FAN, SIZES = 4, 9
#: More than any change of a level: no limit.
NO_LIMIT = 10**12


@dataclass(frozen=True)
class Below:
    """The rows of ``kind`` with a size below ``limit``, a column of the spans, or up to it."""

    name: str
    kind: str
    limit: str | None = None
    inclusive: bool = False


def limit_of(intervals: DataFrame, name: str, default: float | None) -> Column:
    """The request's own limit, where it has one, else ``default``."""
    fallback = F.lit(NO_LIMIT if default is None else default).cast("double")
    return F.coalesce(F.col(name).cast("double"), fallback) if name in intervals.columns else fallback


def _ends(rows: DataFrame, spans: DataFrame, closed: str) -> DataFrame:
    """``eqmt, key, first, stop``: the number of moments of the machine before a span, and up to its end."""
    first, stop = F.lit(0), F.lit(2 if closed == "both" else 0)
    ends = [F.struct(F.col(ms).alias("at"), edge.alias("edge"), F.lit(last).alias("last")) for ms, edge, last in (("from_ms", first, False), ("to_ms", stop, True))]
    marks = spans.select("eqmt", "key", F.inline(F.array(*ends)))
    moments = rows.select("eqmt", "at").distinct().withColumn("edge", F.lit(1))
    in_time = Window.partitionBy("eqmt").orderBy("at", "edge").rowsBetween(Window.unboundedPreceding, 0)
    read = moments.unionByName(marks, allowMissingColumns=True).withColumn("number", F.sum((F.col("edge") == 1).cast("long")).over(in_time))
    number = lambda last: F.max(F.when(F.col("last") == last, F.col("number")))
    return read.filter(F.col("edge") != 1).groupBy("eqmt", "key").agg(number(False).alias("first"), number(True).alias("stop"))


def _block(k: int, number: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), number.alias("block"))


def _div(number: Column, k: int) -> Column:
    return F.call_function("div", number, F.lit(FAN**k))


def _blocks(number: Column) -> Column:
    """The blocks that hold a number, as rows ``k, block``."""
    return F.inline(F.array(*[_block(k, _div(number, k)) for k in range(SIZES + 1)]))


def _pieces(first: Column, stop: Column) -> Column:
    """The blocks that make up the numbers from ``first`` to before ``stop``, as rows ``k, block``; an empty stretch has one block that holds nothing."""
    found = [F.when(first >= stop, F.array(_block(0, F.lit(-1).cast("long"))))]
    run = lambda a, b, k: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda i: _block(k, i)))
    lo = [_div(first + (FAN**k - 1), k) for k in range(SIZES + 1)]
    hi = [_div(stop, k) for k in range(SIZES + 1)]
    for k in range(SIZES + 1):
        # Whole blocks of this size; those inside one of the next size are left to it.
        if k == SIZES:
            found.append(run(lo[k], hi[k], k))
            continue
        inner = lo[k + 1] < hi[k + 1]
        found.append(run(lo[k], F.when(inner, lo[k + 1] * FAN).otherwise(hi[k]), k))
        found.append(F.when(inner, run(hi[k + 1] * FAN, hi[k], k)))
    none = F.array().cast("array<struct<k:int,block:bigint>>")
    return F.inline(F.flatten(F.array(*[F.coalesce(f, none) for f in found])))


def sums_below(rows: DataFrame, spans: DataFrame, closed: str, asked: list[Below], measures: list[str]) -> DataFrame:
    """``spans`` (``SPAN`` and limits) with a column ``<name>_<measure>`` for each question and measure, 0 where nothing counts.

    ``rows`` has ``eqmt, at, kind, size`` and the measures, whole numbers or decimals.
    """
    kind = rows.schema["eqmt"].dataType
    keys = spans.columns
    spans = spans.withColumn("key", F.struct(*keys)).withColumn("eqmt", F.col("eqmt").cast(kind))
    sized = rows.withColumn("size", F.col("size").cast("double"))
    numbered = sized.withColumn("number", F.dense_rank().over(Window.partitionBy("eqmt").orderBy("at")).cast("long") - 1)
    cut_out = _ends(rows, spans, closed).select("key", "eqmt", _pieces(F.col("first"), F.col("stop")))

    def question(q: Below) -> Column:
        limit = F.col(f"key.{q.limit}") if q.limit else F.lit(float(NO_LIMIT))
        return F.struct(F.lit(q.name).alias("name"), F.lit(q.kind).alias("kind"), limit.alias("size"), F.lit(2 if q.inclusive else 0).alias("side"))

    put = cut_out.select("*", F.inline(F.array(*map(question, asked))))
    placed = numbered.select("eqmt", "kind", "size", F.lit(1).alias("side"), *measures, _blocks(F.col("number")))
    by_size = Window.partitionBy("eqmt", "kind", "k", "block").orderBy("size", "side").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.unionByName(put, allowMissingColumns=True).withColumns({m: F.sum(m).over(by_size) for m in measures})
    found = ranked.filter(F.col("side") != 1).groupBy("key").agg(
        *[F.coalesce(F.sum(F.when(F.col("name") == q.name, F.col(m))), F.lit(0)).alias(f"{q.name}_{m}") for q in asked for m in measures]
    )
    return found.select("key.*", *[f"{q.name}_{m}" for q in asked for m in measures])


def usable_spans(intervals: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """The distinct usable spans with their limits."""
    usable = (F.col("bounds_status") == "ok") & (F.col("from_ms") <= F.col("to_ms"))
    chosen = intervals.filter(usable & F.col("eqmt").isNotNull())
    return chosen.select(*SPAN, *[limit.alias(name) for name, limit in limits.items()]).distinct()


def answer_by_limit(intervals: DataFrame, found: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """Gives every request the result of its span and limits; requests without one get NULLs."""
    own = {name: f"{name}__" for name in limits}
    asked = intervals.withColumns({own[name]: limit for name, limit in limits.items()})
    found = found.withColumnsRenamed(own).withColumn("eqmt", F.col("eqmt").cast(intervals.schema["eqmt"].dataType))
    return asked.join(found, [*SPAN, *own.values()], "left").drop(*own.values())
