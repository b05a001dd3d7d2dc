"""Exact copies, found by an extendible-hash index that lies as files in the shared folder.

Texts are alike when they are the same after each run of white space is replaced by one space. The index has
an entry per different text, addressed by a 64-bit hash:

1. every task combines the copies among its own rows; what is left goes to the task that owns its key, where texts
   of one hash are compared byte by byte. Different texts with one hash form a chain and are told apart by place;
2. the directory doubles: it looks at one more bit of the hash wherever a bucket has more than ``capacity`` keys,
   and leaves the others as they are. All sums that some doublings need are made in one pass over the keys;
3. buckets are stored in ranges of the hash, each written by one task, chains side by side.

Every row is then looked up. Classes with more than a thousandth of all rows, so fewer than a thousand of them, are broadcast;
the rest is joined by key, so that no key gathers more than that at one task. All steps are built-in functions.

Edge cases: NULL text is an empty one; a very long text goes to its owner once per task that has it; of rows with
equal text and equal smallest id, one stays; NULL ids stay only in a group without other ids; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankline.llm.common import barrier, shared_folder, stored

CAPACITY = 4096
#: A round of the directory looks at this many bits.
DOUBLINGS = 8
HASH_BITS = 64
#: Classes with more than one row in so many are broadcast.
BROAD = 1000

KEY = ["hash", "sha"]


@dataclass(frozen=True)
class TextIndex:
    """``entries``: a row per document; ``buckets``: a row per different text, with its bucket and place in the chain."""

    entries: DataFrame
    buckets: DataFrame


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t-\r]+", " ")


def prefix(value: Column, bits: int | Column, of: int = HASH_BITS) -> Column:
    """The first ``bits`` of a number of ``of`` bits."""
    if isinstance(bits, int) and bits == 0:
        return F.lit(0).cast("long")
    return F.call_function("shiftrightunsigned", value, (F.lit(of) - bits).cast("int"))


def _hashed(docs: DataFrame, keep: list[str], bits: int) -> DataFrame:
    """``keep``, ``norm`` and ``hash``, of which only the first ``bits`` are used."""
    df = barrier(docs, keep, norm=normalized(F.col("text")))
    key = F.xxhash64("norm")
    return df.withColumn("hash", key if bits == HASH_BITS else F.call_function("shiftleft", prefix(key, bits), F.lit(HASH_BITS - bits)))


def split_buckets(classes: DataFrame, capacity: int, folder: str) -> DataFrame:
    """Adds ``depth`` and ``bucket``, the first ``depth`` bits of ``hash``: as few as leave at most ``capacity`` keys in a bucket.

    ``classes`` are stored rows with ``hash`` and ``place``. The directory starts at a depth where buckets would hold some times their
    capacity. What is still too full after a round goes into the next; a single key is never too full, so 64 bits are enough.
    """
    n = classes.filter("place = 1").count()
    low = max(0, ceil(log2(max(n / capacity, 1))) - 2)
    rest, parts = classes, []
    while True:
        high = min(low + DOUBLINGS, HASH_BITS)
        rest = rest.withColumn("slot", prefix(F.col("hash"), high))
        slots = rest.filter("place = 1").groupBy("slot").agg(F.count(F.lit(1)).alias("held"))
        depths = slots.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        depths = depths.withColumn("bucket", prefix(F.col("slot"), F.col("depth"), high))
        held = F.sum("held").over(Window.partitionBy("depth", "bucket"))
        fits = F.min(F.when(F.col("held_by_bucket") <= capacity, F.struct("depth", "bucket")))
        chosen = depths.withColumn("held_by_bucket", held).groupBy("slot").agg(fits.alias("fits")).select("slot", "fits.*")
        chosen = stored(chosen, folder, f"directory-{high}")
        parts.append(rest.join(chosen.filter("depth IS NOT NULL"), "slot").drop("slot"))
        over = chosen.filter("depth IS NULL").select("slot")
        if over.isEmpty():
            break
        rest, low = rest.join(over, "slot", "left_semi").drop("slot"), high
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def index_texts(docs: DataFrame, capacity: int = CAPACITY, bits: int = HASH_BITS) -> TextIndex:
    """The index of all texts; with fewer ``bits`` of the hash the chains become longer and the result stays the same."""
    folder = shared_folder(docs.sparkSession)
    entries = _hashed(docs, ["doc_id"], bits).select(F.monotonically_increasing_id().alias("row"), "doc_id", "hash", F.unhex(F.sha2("norm", 256)).alias("sha"))
    entries = stored(entries, folder, "entries")
    # Grouped by the text itself: this is where bytes are compared.
    texts = _hashed(docs, [], bits).groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("size"))
    texts = texts.select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "size")
    chain = Window.partitionBy("hash").orderBy("sha")
    clash = F.coalesce(F.lag("sha").over(chain) == F.col("sha"), F.lit(False))
    place = F.when(clash, F.raise_error(F.lit("two different texts of one chain have the same SHA-256"))).otherwise(F.row_number().over(chain))
    texts = texts.withColumn("place", place.cast("int"))
    # Of the rows with the smallest id, any one; rows without id count only where there is no other.
    firsts = entries.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"))
    classes = stored(texts.join(firsts, KEY), folder, "classes")
    buckets = split_buckets(classes, capacity, folder)
    return TextIndex(entries, stored(buckets.repartitionByRange("hash").sortWithinPartitions("hash", "place"), folder, "buckets"))


def look_up(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """The class of every entry."""
    limit = (buckets.agg(F.sum("size")).first()[0] or 0) // BROAD
    large, found = F.col("size") > limit, ["keep_id", "keep_row", "size"]
    marked = entries.join(F.broadcast(buckets.filter(large).select(*KEY, *found)), KEY, "left")
    rest = marked.filter("keep_row IS NULL").drop(*found).join(buckets.filter(~large).select(*KEY, *found), KEY)
    return marked.filter("keep_row IS NOT NULL").unionByName(rest)


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, bits: int = HASH_BITS) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    index = index_texts(docs, capacity, bits)
    return look_up(index.entries, index.buckets).select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
