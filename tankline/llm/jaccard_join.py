"""N-gram Jaccard join over count vectors in R-trees.

A document's set is the 64-bit hashes of its distinct 5-word shingles. The hashes fall into ``GROUPS``
groups; the number in each is one coordinate of the document's point. Two sets share at most the
sum of the coordinates' minima, which bounds their overlap from above, for points and for boxes alike.

1. Sets that are equal become one class, its smallest id stands for it.
2. Whatever order shingles are put in, two sets with a Jaccard of t share one of the first
   n - ceil(t n) + 1 in that order. Classes that share such a shingle form a bucket, which is streamed,
   cut into tiles of ``TILE`` classes (each with the bucket's first one) and kept once if several
   shingles give the same classes. Shingles frequent in a sample come last in the order.
3. An R-tree over each tile finds, for every class, the class with the smallest id whose bound admits
   a link. These pairs are verified on whole sets; the links give components.
4. Buckets that still hold several components are searched once more, all tiles against each other,
   and now every admissible pair between two components is verified.

So no link between two components is lost, and copies by the thousand cost pairs in proportion to
their number. Verified links form a forest, not the list of all links.

Edge cases: NULL and empty texts, and texts of white space, have no shingles and stand alone; texts
with fewer than five words have one; rows repeated exactly share their class; rows without ``doc_id``
take the component of equal texts that have one, else NULL; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import in_sample, shared_folder, stored
from tankline.llm.components import components

WIDTH = 5
#: The similarity asked for, as a fraction.
OVER, UNDER = 75, 100
GROUPS = 1024
TILE = 256
LEAF = 16
ROWS = 512
#: Size of the bitmap that picks the texts to read again: 2^18 rows of 64 bits.
BITS = 1 << 24
#: Documents whose shingles are counted to put frequent ones last, and the share of them from which one is frequent.
SAMPLE, FREQUENT = 20_000, 0.001

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _folded(codes: np.ndarray, n: int, width: int) -> np.ndarray:
    """Hashes of the ``width`` codes from each of ``n`` places on."""
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = _mixed(h * MULTIPLIER + codes[k : k + n])
    return h


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [(t or "").encode().lower().split() for t in texts]
    hashes = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*split)}
    codes = np.array([hashes[w] for words in split for w in words], dtype=np.uint64)
    windows = _folded(codes, max(0, len(codes) - width + 1), width)  # also those across two texts, left out below
    found, start = [], 0
    for words in split:
        n = len(words)
        if n < width:
            own = _folded(codes[start : start + n], min(n, 1), n)
        else:
            own = windows[start : start + n - width + 1]
        found.append(np.unique(own))
        start += n
    return found


def node_of(shingles: np.ndarray) -> int:
    """A hash of the whole set; with its size it names the set's class."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "little", signed=True)


def point(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups)


def _packed(counts: np.ndarray) -> bytes:
    """Most counts are 0 or 1, so a point takes about a tenth of its numbers."""
    plain = counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(plain)


def _unpacked(data: bytes, groups: int = GROUPS) -> np.ndarray:
    plain = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(plain, dtype=np.uint8 if len(plain) == groups else np.uint32)


def prefix(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of which two sets that link share one: infrequent ones first, then by hash."""
    n = len(shingles)
    if not n:
        return shingles
    size = n - -(-OVER * n // UNDER) + 1
    at = np.minimum(np.searchsorted(frequent, shingles), max(0, len(frequent) - 1))
    late = frequent[at] == shingles if len(frequent) else np.zeros(n, dtype=bool)
    return np.concatenate([shingles[~late], shingles[late]])[:size]


def linked(overlap: int, a: int, b: int) -> bool:
    return UNDER * overlap >= OVER * (a + b - overlap)


# --- the tree ---------------------------------------------------------------------------------------


@dataclass
class Node:
    """A box: the greatest count per group and the smallest set in it; ``items`` only at a leaf."""

    top: np.ndarray
    least: int
    items: np.ndarray | None
    below: tuple[Node, ...] = ()


def build(points: np.ndarray, sizes: np.ndarray, items: np.ndarray, leaf: int = LEAF) -> Node:
    """Bulk-loads a tree: halves the items along the coordinate (or size) that varies most."""
    top, least = points[items].max(axis=0), int(sizes[items].min())
    if len(items) <= leaf:
        return Node(top, least, items)
    spread = points[items].var(axis=0)
    axis = int(spread.argmax())
    by = sizes[items] if sizes[items].var() > spread[axis] else points[items, axis]
    order = items[np.argsort(by, kind="stable")]
    half = len(order) // 2
    return Node(top, least, None, (build(points, sizes, order[:half], leaf), build(points, sizes, order[half:], leaf)))


def admissible(points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Self-join of a tree: arrays (i, j, bound) of all pairs whose overlap bound lets them link."""
    need = lambda a, b: -(-OVER * (a + b) // (OVER + UNDER))
    root = build(points, sizes, np.arange(len(sizes)), leaf)
    todo = [(root, root)]
    while todo:
        a, b = todo.pop()
        if np.minimum(a.top, b.top).sum(dtype=np.int64) < need(a.least, b.least):
            continue
        if a.items is not None and b.items is not None:
            bound = np.minimum(points[a.items][:, None, :], points[b.items][None, :, :]).sum(axis=2, dtype=np.int64)
            fits = bound >= need(sizes[a.items][:, None], sizes[b.items][None, :])
            if a is b:
                fits = np.triu(fits, 1)
            i, j = np.nonzero(fits)
            if len(i):
                yield a.items[i], b.items[j], bound[i, j]
        elif a is b:
            left, right = a.below
            todo += [(left, left), (right, right), (left, right)]
        elif b.items is not None or (a.items is None and len(a.top) and a.least >= b.least):
            todo += [(x, b) for x in a.below]
        else:
            todo += [(a, x) for x in b.below]


def _first(points: np.ndarray, sizes: np.ndarray, rep: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each item the one with the smallest id that its bound admits, if that is smaller than its own."""
    best = np.full(len(rep), -1)
    for i, j, _ in admissible(points, sizes):
        low, high = np.where(rep[i] < rep[j], i, j), np.where(rep[i] < rep[j], j, i)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            if best[b] < 0 or rep[a] < rep[best[b]]:
                best[b] = a
    return ((int(a), b) for b, a in enumerate(best) if a >= 0)


def _between(points: np.ndarray, sizes: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Every admissible pair of items of two components."""
    for i, j, _ in admissible(points, sizes):
        differ = part[i] != part[j]
        yield from zip(i[differ].tolist(), j[differ].tolist(), strict=True)


# --- Spark stages -----------------------------------------------------------------------------------


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles in more than a share of a bounded sample of documents; any choice keeps the join exact."""
    total = docs.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample = docs.filter(in_sample(share, "shingle sample", "doc_id", "text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                sets = shingle_sets(batch.slice(at, ROWS).column(0).to_pylist())
                values, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["shingle", "n"])

    counts = sample.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    least = max(3, int(FREQUENT * share * total))
    found = counts.filter(F.col("n") >= least).select("shingle").toPandas()["shingle"].to_numpy(dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), size ``n``, ``node`` (a hash of the set), its ``point`` and, once per set and task, in a row with an id, its prefix ``keys``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("point", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                named = part.column(0).is_valid().to_pylist()
                for s, has_id in zip(shingle_sets(part.column(2).to_pylist()), named, strict=True):
                    node = node_of(s)
                    keys = prefix(s, shared.value).view(np.int64) if has_id and node not in seen else []
                    if has_id:
                        seen.add(node)
                    rows.append((len(s), node, _packed(point(s)), keys))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[2:], strict=True)]], schema=schema)

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n long, node long, point binary, keys array<bigint>")


def _may_link(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """Whether two classes (node, n, place of the key in its order) may link if this key is the first that they share.

    Neither has anything in common with the other before it. Two sets that link do have a first
    shared key, so a pair need not be looked at in other buckets.
    """
    rest = min(a[1] - a[2], b[1] - b[2])
    return (OVER + UNDER) * rest >= OVER * (a[1] + b[1])


def _partnered(held: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The classes of a bucket, ordered by size, that may link with another one of it."""
    if len(held) <= 8:
        return [a for i, a in enumerate(held) if any(_may_link(a, b) for k, b in enumerate(held) if k != i)]
    close = [UNDER * a[1] >= OVER * b[1] for a, b in zip(held, held[1:], strict=False)]
    return [x for k, x in enumerate(held) if (k and close[k - 1]) or (k < len(close) and close[k])]


def _buckets(keys: DataFrame) -> DataFrame:
    """``key``, ``tile``, ``node``, ``n``: the classes that share a key, where two or more may link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        out: list[tuple[int, int, int, int]] = []
        held: list[tuple[int, int, int]] = []  # (node, n, place of the key) of the open tile
        key, tile = None, 0

        def close(whole: bool = True) -> None:
            members = _partnered(held) if whole and not tile else held
            if len(members) < 2:
                return
            if whole and not tile:
                mark = xxhash.xxh3_128_digest(np.array([x for x, *_ in members], dtype=np.int64).tobytes())
                if mark in seen:
                    return
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(mark)
            out.extend((key, tile, node, n) for node, n, _ in members)

        last = np.empty((0, 4), dtype=np.int64)  # the row before, whose key may go on
        for batch in batches:
            rows = np.concatenate([last, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])])
            last = rows[-1:]
            rows = rows[:-1] if len(rows) else rows
            follows = np.append(rows[1:, 0], last[:, 0])[: len(rows)] == rows[:, 0]
            before = np.append([False], rows[1:, 0] == rows[:-1, 0]) if len(rows) else np.empty(0, dtype=bool)
            if len(rows) and key is not None:
                before[0] = rows[0, 0] == key
            for k, n, node, at in rows[follows | before].tolist():
                key, tile, held = _add(k, (node, n, at), key, tile, held, close)
            if out:
                yield _bucket_rows(out)
                out.clear()
        for k, n, node, at in last.tolist():
            if k == key:
                key, tile, held = _add(k, (node, n, at), key, tile, held, close)
        close()
        if out:
            yield _bucket_rows(out)

    order = keys.repartition(F.col("key")).sortWithinPartitions("key", "n", "node")
    return order.select("key", "n", "node", "place").mapInArrow(run, "key long, tile int, node long, n long")


def _add(k, row, key, tile, held, close):
    """The open tile after one more row."""
    if k != key:
        close()
        return k, 0, [row]
    if held[-1][0] == row[0] or held[0][0] == row[0]:
        return key, tile, held
    if len(held) > TILE:
        close(whole=False)
        return key, tile + 1, [held[0], row]
    held.append(row)
    return key, tile, held


def _bucket_rows(out: list) -> pa.RecordBatch:
    k, t, node, n = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(t, pa.int32()), pa.array(node, pa.int64()), pa.array(n, pa.int64())], ["key", "tile", "node", "n"])


def _searched(tiles: DataFrame, keys: list[str], everything: bool) -> DataFrame:
    """Pairs ``a`` < ``b`` of classes that a tree over each tile finds; ``tiles`` has ``rep``, ``n``, ``point``, ``part``."""

    def search(rows: dict) -> tuple[list[int], list[int]]:
        points = np.stack([_unpacked(p) for p in rows["point"]])
        sizes = np.array(rows["n"], dtype=np.int64)
        rep = rows["rep"]
        found = _between(points, sizes, np.array(rows["part"])) if everything else _first(points, sizes, np.array(rep))
        pairs = {(min(rep[i], rep[j]), max(rep[i], rep[j])) for i, j in found}
        return [a for a, _ in pairs], [b for _, b in pairs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        rest: pa.Table | None = None
        for batch in chain(batches, [None]):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                table = pa.concat_tables([rest, table]) if table is not None else rest
            if table is None or not table.num_rows:
                continue
            marks = np.column_stack([table[k].to_numpy() for k in keys])
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            starts = [0, *cuts.tolist()]
            ends = [*cuts.tolist(), table.num_rows]
            if batch is not None:  # the last tile may go on
                rest = table.slice(starts[-1]).combine_chunks()
                starts, ends = starts[:-1], ends[:-1]
            columns = table.select(["rep", "n", "point", "part"]).to_pydict()
            first, second = [], []
            for s, e in zip(starts, ends, strict=True):
                a, b = search({name: c[s:e] for name, c in columns.items()})
                for pair in zip(a, b, strict=True):
                    if pair not in done:
                        done.add(pair)
                        first.append(pair[0])
                        second.append(pair[1])
            if len(done) > 1_000_000:
                done.clear()
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])

    rows = tiles.repartition(*keys).sortWithinPartitions(*keys, "n", "rep").select(*keys, "rep", "n", "point", "part")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _needed(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Documents whose id may be in ``reps``; drops most others before anything is shuffled.

    Each id sets one of ``BITS`` bits. The words of that bitmap, 64 bits each, are the rows of the
    broadcast table, so it has ``BITS`` / 64 rows at most, however many ids there are.
    """
    bit = lambda name: F.pmod(F.xxhash64(F.col(name)), F.lit(BITS))
    words = reps.groupBy(F.floor(bit("rep") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit("rep") % 64).cast("int"))).alias("mask"))
    near = docs.withColumn("word", F.floor(bit("doc_id") / 64)).join(F.broadcast(words), "word")
    return near.filter(F.call_function("shiftright", F.col("mask"), (bit("doc_id") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("word", "mask")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose whole sets link. Only texts of classes in some pair are read again."""
    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(classes.select("rep", "node"), "rep")
    own = _needed(docs.select("doc_id", "text"), reps).join(reps, F.col("doc_id") == F.col("rep")).select("rep", "node", "text")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                a, b, x_node, y_node, x_text, y_text = (c.to_pylist() for c in part.columns)
                texts = list(dict.fromkeys([*x_text, *y_text]))
                sets = dict(zip(texts, shingle_sets(texts), strict=True))
                fits = []
                for m, n, x, y in zip(x_node, y_node, (sets[t] for t in x_text), (sets[t] for t in y_text), strict=True):
                    same = node_of(x) == m and node_of(y) == n  # an id may be repeated with another text
                    fits.append(same and linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
                yield part.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    left = pairs.join(own.select(F.col("rep").alias("a"), F.col("node").alias("m"), F.col("text").alias("x")), "a")
    both = left.join(own.select(F.col("rep").alias("b"), F.col("node").alias("n"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(check, "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, marked: bool = False) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: the smallest id reachable by links, one row per document.

    With ``marked`` also ``mark``, the xxhash64 of the row's text, which tells rows with one id apart.
    """
    folder = shared_folder(docs.sparkSession)
    sets = stored(_sets(docs, _frequent(docs)), folder, "sets")
    classes = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("node", "n")
    classes = stored(classes.agg(F.min("doc_id").alias("rep"), F.first("point").alias("point")), folder, "classes")
    keys = sets.filter(F.col("doc_id").isNotNull()).select(F.posexplode("keys").alias("place", "key"), "n", "node")
    buckets = stored(_buckets(keys), folder, "buckets")

    tiles = buckets.join(classes, ["node", "n"]).withColumn("part", F.col("rep"))
    tried = stored(_searched(tiles, ["key", "tile"], everything=False), folder, "first-pairs")
    links = stored(_verified(tried, docs, classes), folder, "first-links")
    parts = components(links, folder, "first")

    named = buckets.join(classes.select("node", "n", "rep"), ["node", "n"])
    named = named.join(parts.select(F.col("vertex").alias("rep"), "component"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    open_keys = named.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), (F.max("tile") + 1).alias("tiles")).filter("low <> high")
    again = named.join(open_keys.select("key", "tiles"), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    again = again.select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "node", "n", "rep", "part").distinct()
    again = again.join(classes.select("rep", "point"), "rep")
    pairs = _searched(again, ["key", "low", "high"], everything=True).join(tried, ["a", "b"], "left_anti")
    pairs = stored(pairs, folder, "second-pairs")
    links = stored(links.unionByName(_verified(pairs, docs, classes)), folder, "links")
    parts = components(links, folder, "last")

    found = sets.select("doc_id", "mark", "n", "node").join(classes.select("node", "n", "rep"), ["node", "n"], "left")
    found = found.join(parts.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
    columns = ["doc_id", *(["mark"] if marked else []), F.col("n").alias("n_shingles")]
    return found.select(*columns, F.coalesce("component", "rep", "doc_id").alias("component_id"))
