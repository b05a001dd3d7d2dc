"""Best-fit packing of tokenized documents into sequences, improved by swaps.

Documents become token ids and an end id; longer ones than a sequence are cut so that all pieces
but the first are full. Pieces are dealt evenly to groups of about ``GROUP`` pieces, and each group
is packed in one task: longest pieces first, each into the fullest sequence that still holds it.
Then, while a group has more sequences than its tokens need, a local search moves one piece,
or exchanges one for one, two for one or one for two, from the emptiest sequences into fuller ones,
so that the sum of squared fills grows until sequences are empty or no exchange is left. It works
on the distinct lengths of a sequence, of which there can be no more than 45 in 1024 tokens.

A group wastes about one sequence among thousands, so the groups cost next to nothing and no task
sees more than its group.

Edge cases: NULL and empty texts are one piece that holds the end id; rows repeated exactly are
packed one by one; pieces of equal length are interchangeable, the first in the order of all columns is
placed first; a very long text is encoded at once in its task and cut into as many pieces as it needs; text that
spells a special token is that token, as the tokenizer reads it; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import shared_folder, stored, tell_workers

CAPACITY = 1024
END = 2
#: Pieces packed together in one task.
GROUP = 8192
#: Entries of a worker's table of encoded words; when it is full, it starts anew.
KNOWN = 1_200_000
ROWS = 512

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    This vocabulary's pattern never joins two words, and a single space or line end before a word
    belongs to it alone. So a text with only such gaps is the sum of its words' ids, and each
    distinct word is encoded once. Other texts are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _parts(self, text: str) -> list[str] | None:
        """A text's words: after a space as they are, after a line end with it, the first after two line ends.

        None for other texts, and for those that hold an added token.
        """
        if any(token in text for token in self.added):
            return None
        parts = text.replace("\n", " \n").split(" ")
        if len(parts) != len(text.split()) or "" in parts:
            return None
        parts[0] = "\n\n" + parts[0]
        return parts

    @staticmethod
    def _text(part: str) -> str:
        return part[2:] if part.startswith("\n\n") else part if part.startswith("\n") else " " + part

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._parts(t) for t in texts]
        others = dict(zip(rest := [t for t, p in zip(texts, split, strict=True) if p is None], self._whole(rest), strict=True))
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list({x for p in split if p is not None for x in p}.difference(self.known))
        self.known.update(zip(new, self._whole([self._text(x) for x in new]), strict=True))
        get = self.known.__getitem__
        return [others[t] if p is None else b"".join(map(get, p)) for t, p in zip(texts, split, strict=True)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: the first may be short, the others are full."""
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def token_pieces(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, the ``ids`` of every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        schema, fields = schema.append(pa.field("ids", pa.list_(pa.int64()))), fields + ", ids array<bigint>"
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS).to_pydict()
                out: list[list] = [[] for _ in schema]
                for doc_id, ids in zip(part["doc_id"], encode([t or "" for t in part["text"]]), strict=True):
                    ids += last
                    for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = [doc_id, k, start, length, zlib.crc32(own)]
                        if with_ids:
                            row.append(np.frombuffer(own, dtype="<u4").tolist())
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    tell_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0  # bit s is set where some bin has s left
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = open_spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_spaces ^= 1 << space
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if space > n:
            by_space[space - n].append(b)
            open_spaces |= 1 << (space - n)
    return bins


def _pair_sums(held: Counter) -> dict[int, tuple[int, int]]:
    """What two pieces of a bin have together, with their lengths."""
    kinds = sorted(held)
    return {a + b: (a, b) for k, a in enumerate(kinds) for b in kinds[k:] if a != b or held[a] > 1}


class _Search:
    """Bins as counts of lengths; every distinct length and pair of an open bin stands in one array for all bins."""

    def __init__(self, bins: list[list[int]], capacity: int):
        self.capacity = capacity
        self.bins = [Counter(b) for b in bins]
        self.fill = np.array([sum(b) for b in bins], np.int64)
        self.pairs = [_pair_sums(b) for b in self.bins]
        self.kinds = [frozenset(b.items()) for b in self.bins]
        self._list()

    def _list(self) -> None:
        open_bins = [b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity]
        tables = [[(n, b) for b in open_bins for n in of[b]] for of in (self.bins, self.pairs)]
        self.values = [np.array([n for n, _ in t], np.int64) for t in tables]
        self.owners = [np.array([b for _, b in t], np.int64) for t in tables]
        self.open = np.array(open_bins, np.int64)

    def best(self, poor: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]]:
        """The exchange from ``poor`` into the fullest bin that takes one: gain, bin, lengths given, lengths back.

        Only bins as full as ``poor`` or fuller are asked. Of one bin's exchanges it is the one that moves most tokens.
        """
        space, worst = self.capacity - self.fill, np.iinfo(np.int64).max
        found, least = (0, -1, (), ()), worst
        fits = [(o != poor) & (self.fill[o] >= self.fill[poor]) for o in (self.open, *self.owners)]

        def take(n: int, given: tuple[int, ...], values: np.ndarray, owners: np.ndarray, fit: np.ndarray, kind: int) -> None:
            nonlocal found, least
            can = fit & (values < n) & (n - values <= space[owners])
            order = np.where(can, (space[owners] * len(self.bins) + owners) * (self.capacity + 1) + values + self.capacity - n, worst)
            at = int(order.argmin()) if len(order) else -1
            if at < 0 or order[at] >= least:
                return
            least, b, back = int(order[at]), int(owners[at]), int(values[at])
            found = n - back, b, given, () if kind == 0 else (back,) if kind == 1 else self.pairs[b][back]

        nothing = np.zeros(len(self.open), np.int64)
        for n in self.bins[poor]:
            take(n, (n,), nothing, self.open, fits[0], 0)
            take(n, (n,), self.values[0], self.owners[0], fits[1], 1)
            take(n, (n,), self.values[1], self.owners[1], fits[2], 2)
        for n, given in self.pairs[poor].items():
            take(n, given, self.values[0], self.owners[0], fits[1], 1)
        return found

    def exchange(self, poor: int, gain: int, full: int, given: tuple[int, ...], back: tuple[int, ...]) -> None:
        for b, more, less in ((full, given, back), (poor, back, given)):
            self.bins[b] += Counter(more)
            self.bins[b] -= Counter(less)
            self.pairs[b] = _pair_sums(self.bins[b])
            self.kinds[b] = frozenset(self.bins[b].items())
        self.fill[full] += gain
        self.fill[poor] -= gain
        self._list()


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties bins by exchanges that raise the sum of squared fills, while more bins are used than needed."""
    needed, used = -(-sum(lengths) // capacity), len(bins)
    if used <= needed:
        return bins
    search = _Search([[lengths[i] for i in b] for b in bins], capacity)
    # Bins of equal lengths are alike: what one of them has tried in vain the others need not. After a round that changed
    # something all may try again; a round without an exchange is the end.
    tried, changed = set(), False
    while used > needed:
        left = [b for b in search.open.tolist() if search.kinds[b] not in tried]
        if not left:
            if not changed:
                break
            tried, changed = set(), False
            continue
        poor = min(left, key=lambda b: (search.fill[b], b))
        while search.fill[poor] and (found := search.best(poor))[0]:
            search.exchange(poor, *found)
            changed = True
        used -= not search.fill[poor]
        tried.add(search.kinds[poor])
    by_length: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        by_length.setdefault(lengths[i], []).append(i)
    return [[by_length[n].pop() for n in sorted(b.elements(), reverse=True)] for b in search.bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces, each with a ``length`` of at most ``capacity``."""
    groups = max(1, round(pieces.count() / group))
    dealt = pieces.withColumn("pack_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    columns = pieces.columns

    def run(table: pa.Table) -> pa.Table:
        plain = [f.name for f in table.schema if not pa.types.is_nested(f.type)]
        table = table.sort_by([(name, "ascending") for name in plain])
        lengths = table["length"].to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        base = table["pack_group"][0].as_py() << 32
        for number, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = base + number, at
                at += lengths[i]
        placed = table.select(columns).append_column("sequence_id", pa.array(sequence, pa.int64()))
        return placed.append_column("offset", pa.array(offset, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("pack_group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places; they are stored in the shared folder in between."""
    pieces = token_pieces(docs, path, capacity, end, with_ids)
    return pack(stored(pieces, shared_folder(docs.sparkSession), "pieces"), capacity)


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its token ``ids``."""
    placed = pack_documents(docs, with_ids=True, **options)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
