"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source has a weight. Targets share the words of all documents by weight, no target above
``repeats`` times its source; what is cut off goes to the others by weight. The mix is then counted
in blocks of ``block`` words:

1. sources get whole blocks by highest quotients target / (2k - 1);
2. a source that gets more than its own words is taken whole as often as that goes, and the rest
   becomes a quota of blocks below one pass;
3. the quota is divided among the source's shards in the same way, over two levels (groups of
   shards, then shards), so that no window holds more than about the root of the number of shards;
4. in each shard the documents lie in seeded order on a ring of blocks, and as many blocks as the
   quota says are taken from a seeded start. Whole documents stay whole; at most two are cut.

Shards are made by hash and hold about ``shard`` words, so a source with a third of all rows is
spread over as many tasks as its words ask for. All steps are built-in functions.

Edge cases: NULL text has size 0 and is never taken; a NULL source is a source of its own and comes
last; rows repeated exactly are taken one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankline.llm.common import shared_folder, stored, words_of

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 32
SHARD = 65_536
SEED = 11

SOURCE = ["source_key", "source_null"]
SHARD_KEYS = [*SOURCE, "shard_group", "shard"]


def draw(*parts: Column | str) -> Column:
    """A seeded number below 2^28 from the text of some values."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def apportion(df: DataFrame, group: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group, dealt to its rows by highest quotients weight / (2k - 1).

    Rounding gives each row its quota up to a few seats; those are then added or taken away in the
    order of their quotients. With n rows in a group, a row can differ from its rounded share by half
    its share of n and one seat more, so only that many candidates are looked at. Equal quotients go
    to the smaller ``key`` first.
    """
    w = Window.partitionBy(*group)
    total = F.sum(weight).over(w)
    df = df.withColumn("_p", F.when(total > 0, F.col(weight) / total).otherwise(0.0)).withColumn("_n", F.count(F.lit(1)).over(w))
    df = df.withColumn("_q", F.floor(F.col(seats) * F.col("_p") + 0.5)).withColumn("_d", F.col(seats) - F.sum("_q").over(w))
    steps = F.ceil(F.col("_p") * F.col("_n") / 2) + 1
    tries = F.when((F.col("_d") == 0) | (F.col(weight) <= 0), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), steps))
    df = df.select("*", F.explode(tries).alias("_k"))
    seat = F.when(F.col("_d") > 0, F.col("_q") + F.col("_k")).otherwise(F.col("_q") - F.col("_k") + 1)
    quotient = F.when((F.col("_k") > 0) & (seat > 0), F.col(weight) / (2 * seat - 1))
    up = Window.partitionBy(*group).orderBy(F.col("_quotient").desc_nulls_last(), *key)
    down = Window.partitionBy(*group).orderBy(F.col("_quotient").asc_nulls_last(), *[F.col(k).desc() for k in key])
    df = df.withColumn("_quotient", quotient)
    df = df.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    chosen = F.col("_quotient").isNotNull()
    change = F.when(chosen & (F.col("_d") > 0) & (F.col("_up") <= F.col("_d")), 1).when(chosen & (F.col("_d") < 0) & (F.col("_down") <= -F.col("_d")), -1).otherwise(0)
    df = df.withColumn("quota", (F.col("_q") + F.sum(change).over(Window.partitionBy(*group, *key))).cast("long"))
    return df.filter(F.col("_k") == 0).drop("_p", "_n", "_q", "_d", "_k", "_quotient", "_up", "_down")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` (words) to one row per source with ``source_size``.

    Sources are ordered by how soon they reach their limit. Those before the first one that stays
    below it are full; the others share what is left by weight. One row per source is all this sees.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy("source_null", "source_key")
    place = F.row_number().over(by_name) - 1
    df = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place % len(weights)).cast("long"))
    df = df.withColumn("limit", repeats * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = everything.orderBy("ratio", "source_null", "source_key")
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (F.sum("source_size").over(everything) - before) / left)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return df.withColumn("target", F.least(F.col("limit").cast("double"), level * F.col("weight"))).drop("limit", "ratio", "level")


def _overlap(begin: Column, end: Column) -> tuple[Column, Column]:
    """The part of a document's words [first, first + size) that lies in [begin, end), from the document's start."""
    first, size = F.col("first"), F.col("size")
    return F.greatest(begin, first) - first, F.least(end, first + size) - first


def mix(
    docs: DataFrame,
    keep: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``keep`` columns, ``size``, ``source_size``, ``target``, ``passes``, ``spans``, ``taken``.

    The mix takes the whole document ``passes`` times and, beyond that, the word ranges ``spans``
    (from, to; two at most); ``taken`` counts the words of both.
    """
    folder = shared_folder(docs.sparkSession)
    keep = tuple(dict.fromkeys(("doc_id", *keep)))
    sized = docs.select(
        F.struct(*keep).alias("kept"),
        F.col("doc_id").alias("id"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.col("source").isNull().alias("source_null"),
        F.size(words_of(F.col("text"))).cast("long").alias("size"),
    )
    sized = stored(sized, folder, "sized")
    sources = targets(sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")), weights, repeats)
    seats = F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block + 0.5)
    sources = apportion(sources.withColumn("seats", seats).withColumn("all", F.lit(0)), ["all"], SOURCE, "target", "seats")
    words = F.col("quota") * block
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(words / F.col("source_size")), F.lit(repeats))).otherwise(0)
    rest = F.when(passes < repeats, F.floor((words - passes * F.col("source_size")) / block + 0.5)).otherwise(0)
    shards = F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1))
    groups = F.ceil(F.sqrt(shards))
    sources = sources.select(
        *SOURCE,
        "source_size",
        "target",
        passes.cast("long").alias("passes"),
        rest.cast("long").alias("blocks"),
        groups.cast("long").alias("groups"),
        F.ceil(shards / groups).cast("long").alias("per_group"),
    )
    sources = stored(sources, folder, "sources")
    placed = sized.join(sources, SOURCE).withColumns(
        {
            "shard_group": F.pmod(draw(f"group {seed}", F.col("id")), F.col("groups")),
            "shard": F.pmod(draw(f"shard {seed}", F.col("id")), F.col("per_group")),
        }
    )
    sums = placed.groupBy(*SHARD_KEYS).agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    upper = sums.groupBy(*SOURCE, "shard_group").agg(F.sum("shard_size").alias("group_size"), F.first("blocks").alias("blocks"))
    upper = apportion(upper, SOURCE, ["shard_group"], "group_size", "blocks").select(*SOURCE, "shard_group", F.col("quota").alias("group_blocks"))
    lower = apportion(sums.join(upper, [*SOURCE, "shard_group"]), [*SOURCE, "shard_group"], ["shard"], "shard_size", "group_blocks")
    quotas = lower.select(*SHARD_KEYS, "shard_size", "quota")

    ring = F.floor(F.col("shard_size") / block) * block
    long = F.when(F.col("quota") * block >= ring, F.col("shard_size")).otherwise(F.col("quota") * block)
    long = F.when(F.col("quota") == 0, 0).otherwise(long)
    begin = F.when(long < ring, F.pmod(draw(f"start {seed}", *map(F.col, SHARD_KEYS)), F.greatest(F.floor(ring / block), F.lit(1))) * block)
    order = Window.partitionBy(*SHARD_KEYS).orderBy(F.md5(F.concat(F.lit(f"order {seed}|"), F.coalesce(F.col("id").cast("string"), F.lit("")))), "id", "size")
    df = placed.join(quotas, SHARD_KEYS)
    df = df.withColumn("first", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    df = df.withColumns({"ring": F.when(long < ring, ring).otherwise(F.col("shard_size")), "long": long, "begin": F.coalesce(begin, F.lit(0))})
    stop = F.col("begin") + F.col("long")
    parts = [_overlap(F.lit(0), stop - F.col("ring")), _overlap(F.col("begin"), F.least(stop, F.col("ring")))]
    spans = F.filter(F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop")) for a, b in parts]), lambda s: s["stop"] > s["start"])
    df = df.withColumn("spans", spans)
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return df.select(
        *[F.col(f"kept.{k}").alias(k) for k in keep],
        "size",
        "source_size",
        "target",
        "passes",
        "spans",
        (F.col("passes") * F.col("size") + extra).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole texts as often as they are passed, then cut ones.

    A cut text holds the words of its spans, joined by single spaces, and its own ``n_chars``.
    """
    document = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    df = mix(docs.select(document, "doc_id", "source", "text"), keep=("document",), **options)
    text = F.col("document.text")
    whole = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]) == F.col("size")
    times = F.col("passes") + (whole & (F.col("size") > 0)).cast("long")
    cut = ~whole & (F.size("spans") > 0)
    words = words_of(text)
    pieces = F.flatten(F.transform("spans", lambda s: F.slice(words, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    copies = F.concat(
        F.array_repeat(text, times.cast("int")),
        F.when(cut, F.array(F.array_join(pieces, " "))).otherwise(F.array().cast("array<string>")),
    )
    df = df.select("document", F.explode(copies).alias("copy"))
    fixed = {"text": F.col("copy"), "n_chars": F.length("copy").cast("long")}
    return df.select(*[fixed.get(c, F.col(f"document.`{c}`")).alias(c) for c in docs.columns])
