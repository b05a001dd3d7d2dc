"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the smallest vertex around each vertex: the larger ones, or the smaller ones and itself."""
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.unionByName(swapped) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``vertex`` and ``component``, the smallest vertex that it is connected with; only vertices with edges have rows.

    ``edges`` has two columns of numbers ``a`` and ``b``. Each round writes its edges to the shared
    folder; the rounds end when every vertex is linked to its smallest one only. Their number grows with
    the logarithm of the edges.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before, turn = stored(ordered, folder, f"{name}-0"), None, 0
    while True:
        # Done if no vertex has two smaller neighbours and no smaller neighbour has one itself.
        sums = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == (sums["n"], sums["s"]):
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
            )
        before, turn = (sums["n"], sums["s"]), turn + 1
        edges = stored(_stars(_stars(edges, large=True), large=False), folder, f"{name}-{turn}")
