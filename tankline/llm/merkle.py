"""Merkle manifest of a dataset whose nodes keep hash states, so that a changed leaf is folded without its left side.

Every row is a leaf. Leaves of one group (``lang``) ascend by id; runs of ``arity`` consecutive nodes become
their hash until one is left, the subroot; subroots ordered by group likewise give the root. A parent keeps a
copy of its hash state from before each child's slot (``sha_states``). To fold a replaced leaf, the state before its
slot is resumed, fed the replacement and the siblings to the right, and finished; left siblings are not read.

The tree is stored as tables in the shared folder, cut into blocks of at most ``BLOCK_NODES`` nodes: a row holds
a block's nodes and states. One pass over the blocks of a height makes those of the next height, and one pass
down hands every block its path to the root. No task holds more than a few blocks, whatever the size of a group.

Edge cases: NULLs count as ``-``; NULL ids come first and are never tampered with; rows with equal ids are ordered
by their leaf; rows repeated exactly are leaves of their own; a very long text only counts through its leaf; a lone leaf
is its own subroot, a lone subroot the root, and its proof is the hash of nothing; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankline.llm.common import shared_folder, stored
from tankline.llm.sha_states import BYTES, WORDS, feed, finish, pack, parents, unpack

ARITY = 2
#: A block of nodes holds no more than this.
BLOCK_NODES = 64
#: Blocks handled at once in a task.
AT_ONCE = 128

BLOCK = "key string, block long, n long, size int, height int, ids array<long>, folded binary, nodes binary, states binary, root binary"
STEP = pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("siblings", pa.binary())])
PATH = "array<struct<slot: int, state: binary, siblings: binary>>"
PATHS = f"key string, block long, path {PATH}, subroot binary, tree_root binary"


@dataclass(frozen=True)
class Tree:
    """``levels``: the stored blocks from the leaves upwards; ``tops``: ``key``, ``node``, one row per tree."""

    levels: list[DataFrame]
    tops: DataFrame


@dataclass(frozen=True)
class Manifest:
    """``groups`` has a tree per group, ``forest`` one tree over their subroots."""

    groups: Tree
    forest: Tree
    arity: int
    folder: str


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    """The digest (32 bytes) of a row of ``documents``."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256))


def tampered_leaf(modulus: int = 7) -> Column:
    """The digest after tampering: one more in ``n_chars`` where the id's crc32 is divisible; NULL where it isn't."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    return F.when(F.crc32(F.col("doc_id").cast("string")) % modulus == 0, leaf(more))


def _ranked(nodes: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """Adds ``rank``, the place of a row within its ``key`` by ``order``, and ``n``, the rows of that key.

    Rows are sorted over all tasks; only the number of rows that each task has of a key is summed up.
    """
    ordered = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), folder, name)
    ordered = ordered.withColumn("part", F.call_function("shiftright", F.col("at"), F.lit(33)))
    runs = ordered.groupBy("key", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("count"))
    by_key = Window.partitionBy("key")
    runs = runs.select(
        "key",
        "part",
        (F.coalesce(F.sum("count").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("start")).alias("shift"),
        F.sum("count").over(by_key).alias("n"),
    )
    return ordered.join(runs, ["key", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def levels_of(arity: int) -> int:
    """How many levels a full block has."""
    levels = 1
    while arity ** (levels + 1) <= BLOCK_NODES:
        levels += 1
    return levels


def _heights(n: np.ndarray, arity: int) -> np.ndarray:
    """How often a row of n nodes is hashed within a block, until one is left or the block is full."""
    height, n = np.zeros(len(n), np.int32), n.copy()
    for _ in range(levels_of(arity)):
        height += n > 1
        n = -(-n // arity)
    return height


def climb(leaves: np.ndarray, sizes: np.ndarray, heights: np.ndarray, arity: int) -> tuple[list[tuple], np.ndarray]:
    """The levels of several blocks at once, and their roots.

    ``leaves`` are the digests of all blocks, ``sizes`` many of each. A level is its digests, the states before them,
    the number of nodes of each block (0 where the block is done) and the place of each block's first one.
    """
    roots, levels = np.empty((WORDS, len(sizes)), np.uint32), []
    digests, counts = leaves, sizes.copy()
    for t in range(int(heights.max(initial=0)) + 1):
        done = np.flatnonzero((heights == t) & (counts > 0))
        starts = np.cumsum(counts) - counts
        roots[:, done] = digests[:, starts[done]]
        goes = np.repeat(heights > t, counts)
        digests, counts = digests[:, goes], np.where(heights > t, counts, 0)
        starts = np.cumsum(counts) - counts
        if not digests.shape[1]:
            break
        place = np.arange(digests.shape[1]) - np.repeat(starts, counts)
        above, before = parents(digests, place, arity)
        levels.append((digests, before, counts, starts))
        digests, counts = above, -(-counts // arity)
    return levels, roots


def _levels(nodes: np.ndarray, states: np.ndarray, sizes: np.ndarray, heights: np.ndarray, arity: int) -> list[tuple]:
    """The levels of blocks as ``climb`` gives them, from the stored nodes and states, which stand level by level within each block."""
    levels, counts = [], sizes.copy()
    totals = sum(np.where(heights > t, -(-sizes // arity**t), 0) for t in range(int(heights.max(initial=0)))) + np.zeros(len(sizes), int)
    at = np.cumsum(totals) - totals
    for t in range(int(heights.max(initial=0))):
        counts = np.where(heights > t, -(-sizes // arity**t), 0)
        starts = np.cumsum(counts) - counts
        picked = np.repeat(at - starts, counts) + np.arange(counts.sum())
        levels.append((nodes[:, picked], states[:, picked], counts, starts))
        at = at + counts
    return levels


def _blocks(arity: int):
    """Rows of one block after another (key, block, n, doc_id, node, folded) into one row per block."""

    def made(blocks: list[tuple]) -> pa.RecordBatch:
        keys, numbers, n, ids, nodes, folded = zip(*blocks, strict=True)
        sizes = np.array([len(x) for x in nodes])
        heights = _heights(np.array(n), arity)
        levels, roots = climb(unpack(b"".join(b"".join(x) for x in nodes)), sizes, heights, arity)
        kept, states = [[] for _ in blocks], [[] for _ in blocks]
        for digests, before, counts, starts in levels:
            d, s = pack(digests), pack(before)
            for b in np.flatnonzero(counts):
                cut = slice(int(starts[b]) * BYTES, int(starts[b] + counts[b]) * BYTES)
                kept[b].append(d[cut])
                states[b].append(s[cut])
        top = pack(roots)
        columns = [
            keys, numbers, n, sizes.tolist(), heights.tolist(), ids, [b"".join(x) for x in folded],
            [b"".join(x) for x in kept], [b"".join(x) for x in states], [top[i * BYTES : (i + 1) * BYTES] for i in range(len(blocks))],
        ]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        names = [c.split()[0] for c in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, last = [], None
        for batch in batches:
            for key, block, n, doc_id, node, folded in zip(*batch.to_pydict().values(), strict=True):
                if last is None or last[0] != key or last[1] != block:
                    if len(ready) == AT_ONCE:
                        yield made(ready)
                        ready = []
                    last = (key, block, n, [], [], [])
                    ready.append(last)
                last[3].append(doc_id)
                last[4].append(node)
                last[5].append(folded or b"")
        if ready:
            yield made(ready)

    return run


def _grow(nodes: DataFrame, most: int, arity: int, folder: str, name: str) -> Tree:
    """The trees over ``nodes`` (key, rank, n, doc_id, node, folded), with at most ``most`` nodes each."""
    full, levels = arity ** levels_of(arity), []
    while True:
        dealt = nodes.select("key", F.expr(f"rank div {full}").alias("block"), "rank", "n", "doc_id", "node", "folded")
        dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "rank").drop("rank")
        level = stored(dealt.mapInArrow(_blocks(arity), BLOCK), folder, f"{name}-{len(levels)}")
        levels.append(level)
        most = -(-most // full)
        if most <= 1:
            return Tree(levels, level.select("key", F.col("root").alias("node")))
        nothing = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("folded")]
        nodes = level.select("key", F.col("block").alias("rank"), F.ceil(F.col("n") / full).alias("n"), *nothing, F.col("root").alias("node"))


def _most(ranked: DataFrame) -> int:
    return ranked.agg(F.max("n")).first()[0] or 0


def build_manifest(docs: DataFrame, changed: Column | None = None, arity: int = ARITY) -> Manifest:
    """The manifest of ``docs``; ``changed`` is the digest that stands for a leaf when it is folded, NULL for the leaf's own."""
    folder = shared_folder(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    changed = F.lit(None).cast("binary") if changed is None else changed
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("node"), changed.alias("folded"))
    rows = stored(rows.withColumn("folded", F.coalesce("folded", "node")).withColumn("row", F.monotonically_increasing_id()), folder, "leaves")
    ranked = _ranked(rows, ["doc_id", "node", "row"], folder, "ordered")
    groups = _grow(ranked, _most(ranked), arity, folder, "group")
    subroots = groups.tops.select(F.lit("").alias("key"), F.col("key").alias("name"), F.lit(None).cast("long").alias("doc_id"), "node", F.lit(None).cast("binary").alias("folded"))
    ranked = _ranked(subroots, ["name"], folder, "subroots")
    # The forest's leaves are found again by name; their ranks are kept beside them.
    names = stored(ranked.select("rank", F.col("name").alias("key"), F.col("node").alias("subroot")), folder, "names")
    forest = _grow(ranked.drop("name"), _most(ranked), arity, folder, "forest")
    return Manifest(groups, Tree([*forest.levels, names], forest.tops), arity, folder)


def _steps(levels: list[tuple], b: int, i: int, arity: int, packed: list[tuple[bytes, bytes]]) -> list[dict]:
    """The steps of node ``i`` of block ``b`` up to the block's root."""
    steps = []
    for (_, _, counts, starts), (nodes, states) in zip(levels, packed, strict=True):
        if not counts[b]:
            break
        first, last = i - i % arity, min(i - i % arity + arity, int(counts[b]))
        at = int(starts[b])
        others = nodes[(at + first) * BYTES : (at + i) * BYTES] + nodes[(at + i + 1) * BYTES : (at + last) * BYTES]
        steps.append({"slot": i - first, "state": states[(at + i) * BYTES : (at + i + 1) * BYTES], "siblings": others})
        i //= arity
    return steps


def _slices(batches: Iterable[pa.RecordBatch], arity: int) -> Iterator[tuple[dict, list[tuple]]]:
    """A few block rows at a time, with their levels."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            rows = batch.slice(at, AT_ONCE).to_pydict()
            sizes, heights = np.array(rows["size"]), np.array(rows["height"])
            yield rows, _levels(unpack(b"".join(rows["nodes"])), unpack(b"".join(rows["states"])), sizes, heights, arity)


def _descend(arity: int):
    """Block rows with their path into one row per node with its path: ``PATHS``, ``block`` being the node's rank."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, levels in _slices(batches, arity):
            packed = [(pack(d), pack(s)) for d, s, _, _ in levels]
            out = [[] for _ in range(5)]
            for b, (key, block, size, path, subroot, root) in enumerate(zip(*[rows[c] for c in ("key", "block", "size", "path", "subroot", "tree_root")], strict=True)):
                for i in range(size):
                    for column, value in zip(out, (key, block * arity ** levels_of(arity) + i, _steps(levels, b, i, arity, packed) + path, subroot, root), strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), pa.list_(STEP), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "block", "path", "subroot", "tree_root"])

    return run


def _down(tree: Tree, paths: DataFrame, arity: int, last: int) -> DataFrame:
    """Paths of the blocks of level ``last`` (or, below 0, of the nodes themselves) from those of the topmost blocks."""
    for level in reversed(tree.levels[last + 1 :]):
        blocks = level.select("key", "block", "size", "height", "nodes", "states").join(paths, ["key", "block"])
        paths = blocks.mapInArrow(_descend(arity), PATHS)
    return paths


def resume(digests: np.ndarray, state: np.ndarray, slot: np.ndarray, rights: list[tuple[np.ndarray, np.ndarray]], children: np.ndarray) -> np.ndarray:
    """The parents' digests when children are replaced: the state before the slot, the replacement, the siblings to the right."""
    state = feed(state, digests)
    for at, sibling in rights:
        if len(at):
            state[:, at] = feed(state[:, at], sibling)
    return finish(state, children)


def _fold_in_blocks(digests: np.ndarray, sizes: np.ndarray, levels: list[tuple], arity: int) -> np.ndarray:
    block, node = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])
    for nodes, states, counts, starts in levels:
        on = np.flatnonzero(counts[block] > 0)
        i, b = node[on], block[on]
        slot, at = i % arity, starts[b] + i
        children = np.minimum(arity, counts[b] - (i - slot))
        rights = [(w, nodes[:, at[w] + r]) for r in range(1, arity) for w in [np.flatnonzero(children - slot > r)]]
        digests[:, on] = resume(digests[:, on], states[:, at], slot, rights, children)
        node = node // arity
    return digests


def _fold_along(digests: np.ndarray, paths: list[list[dict]], which: np.ndarray) -> np.ndarray:
    """Folds column i along path ``which[i]``."""
    for s in range(max(map(len, paths), default=0)):
        on = np.flatnonzero(np.array([len(p) > s for p in paths])[which])
        steps = [p[s] if len(p) > s else {"slot": 0, "state": bytes(BYTES), "siblings": b""} for p in paths]
        slot, children = np.array([x["slot"] for x in steps]), np.array([len(x["siblings"]) // BYTES + 1 for x in steps])
        state, siblings = unpack(b"".join(x["state"] for x in steps)), unpack(b"".join(x["siblings"] for x in steps))
        first = np.cumsum(children - 1) - (children - 1)
        p = which[on]
        rights = [(w, siblings[:, (first + slot)[p[w]] + r - 1]) for r in range(1, int(children.max())) for w in [np.flatnonzero((children - slot)[p] > r)]]
        digests[:, on] = resume(digests[:, on], state[:, p], slot[p], rights, children[p])
    return digests


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _folded(arity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, levels in _slices(batches, arity):
            sizes = np.array(rows["size"])
            block = np.repeat(np.arange(len(sizes)), sizes)
            at_block = _fold_in_blocks(unpack(b"".join(rows["folded"])), sizes, levels, arity)
            # Leaves of a block that fold to the same node share the rest of the way.
            ways, way = np.unique(np.vstack([block.astype(np.uint32), at_block]), axis=1, return_inverse=True)
            folded = pack(_fold_along(np.ascontiguousarray(ways[1:]), rows["path"], ways[0].astype(int)))
            folded = [folded[i : i + BYTES].hex() for i in range(0, len(folded), BYTES)]
            packed = [(pack(d), pack(s)) for d, s, _, _ in levels]
            out = [[] for _ in range(7)]
            for b, (ids, path, root, subroot) in enumerate(zip(rows["ids"], rows["path"], rows["tree_root"], rows["subroot"], strict=True)):
                above, root, subroot = b"".join(x["siblings"] for x in path).hex(), root.hex(), subroot.hex()
                leaves = packed[0][0] if rows["height"][b] else rows["root"][b]
                first = int(levels[0][3][b]) if rows["height"][b] else 0
                for i, doc_id in enumerate(ids):
                    proof = b"".join(x["siblings"] for x in _steps(levels, b, i, arity, packed)).hex() + above
                    values = (doc_id, leaves[(first + i) * BYTES : (first + i + 1) * BYTES].hex(), subroot, root, hashlib.sha256(proof.encode()).hexdigest())
                    for column, value in zip(out, values):
                        column.append(value)
                out[5] += [folded[w] for w in way[block == b].ravel()]
            out[6] = [a == b for a, b in zip(out[5], out[3], strict=True)]
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    return run


def fold_leaves(manifest: Manifest) -> DataFrame:
    """One row per leaf: its digests, the hash of its proof, and the root that its changed leaf folds to."""
    arity, (*above, names) = manifest.arity, manifest.forest.levels
    top = [F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("tree_root")]
    paths = _down(Tree(above, manifest.forest.tops), manifest.forest.tops.select("key", *top), arity, -1)
    paths = paths.select(F.col("block").alias("rank"), "path", "tree_root").join(names, "rank")
    paths = stored(paths.select("key", F.lit(0).cast("long").alias("block"), "path", "subroot", "tree_root"), manifest.folder, "group-paths")
    blocks = manifest.groups.levels[0].join(_down(manifest.groups, paths, arity, 0), ["key", "block"])
    return blocks.select("size", "height", "ids", "folded", "nodes", "states", "root", "path", "subroot", "tree_root").mapInArrow(_folded(arity), RESULT)


def verify_tampered(docs: DataFrame, modulus: int = 7, arity: int = ARITY) -> DataFrame:
    """Which rows of ``docs`` fold to the manifest's root after those chosen by ``modulus`` were tampered with."""
    return fold_leaves(build_manifest(docs, tampered_leaf(modulus), arity))
