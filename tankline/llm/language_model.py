"""Katz backoff language model over words, counted from and applied to whole corpora.

Probabilities are bigrams with Good-Turing discounts; what the discounts set free goes to the words
not seen after a word, in proportion to their unigram probability, with a weight that makes each
distribution sum to one exactly. Unigrams leave their share to one unknown word. A token is
evaluated by recursion: its bigram if that was seen, else the weight times its unigram.

Texts are encoded once into blocks (rows of arrays): the distinct words of a block as 64-bit hashes
and its tokens as places in them. Blocks then ask for what they need, each distinct key once: the
counts of their words, of their pairs, and the backoff weights of their words. Keys are dealt to
ranges of about ``RANGE`` tokens; the task of a range sums the counts of all blocks, writes its part
of the tables and answers each block. Since a block asks once, a word that makes up a third of all
tokens costs no more than another; pairs after a frequent word are dealt by their second word.

Tables in the shared folder, partitioned by range: ``unigrams`` (word, count), ``pairs`` (per range the
history, its number of continuations, the words, their counts) and ``weights``.

Edge cases: NULL and empty texts consist of the end token; unseen words are the unknown word; if
nothing is learned every token has probability one; repeated rows are counted and scored one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import held_out, shared_folder, stored

#: Counts above this are not discounted.
TRUSTED = 5
#: Tokens of a block, about; a longer document is a block of its own.
BLOCK = 1_000_000
#: Tokens whose words and pairs go to a range, about.
RANGE = 4_000_000
#: Pairs after a word are spread over all ranges if its share of the tokens is above this part of a range's.
SPREAD = 0.5
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n end", b"\n start"))


def discounts(count_of_counts: dict[int, int], trusted: int = TRUSTED) -> np.ndarray:
    """Katz's factors for counts 0 to ``trusted`` + 1 and above (the last is 1).

    Where the counts of counts allow no proper factor, it is (r - 1/2) / r.
    """
    n = [count_of_counts.get(r, 0) for r in range(trusted + 2)]
    common = (trusted + 1) * n[trusted + 1] / n[1] if n[1] else 1.0
    factors = [1.0]
    for r in range(1, trusted + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        factors.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array([*factors, 1.0])


@dataclass(frozen=True)
class Unigrams:
    """What all tasks know of the unigrams: total, number of words, discounts, share of the unknown word."""

    total: int
    words: int
    factors: np.ndarray
    unknown: float

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        seen = self.factors[np.minimum(counts, TRUSTED + 1)] * counts / self.total
        return np.where(counts > 0, seen, self.unknown)


def unigrams_of(count_of_counts: dict[int, int], total: int, words: int) -> Unigrams:
    """``count_of_counts`` reaches to ``TRUSTED`` + 1; higher counts keep their share."""
    factors = discounts(count_of_counts)
    lost = sum((1 - factors[r]) * r * count_of_counts.get(r, 0) for r in range(1, TRUSTED + 1))
    scale = total + (0 if lost else 1)
    return Unigrams(scale, words, factors, (lost or 1) / scale if total else 1.0)


# --- blocks -----------------------------------------------------------------------------------------


def _encode(docs: DataFrame, learn, block: int) -> DataFrame:
    """Blocks of documents: ids, whether held out, token counts, tokens as places in the sorted word hashes."""
    kinds = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64()), "tokens": pa.int64(), "codes": pa.binary(), "words": pa.binary()}
    schema = pa.schema(list(kinds.items()))

    def row(number: int, ids: list, held: list, lengths: list, tokens: list[int], words: dict) -> pa.RecordBatch:
        hashes = np.array([END, START, *(xxhash.xxh3_64_intdigest(w) for w in words)], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        # Tokens are kept as numbers in the order of first use, which are small; their places in the sorted hashes follow.
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        values = [number, ids, held, lengths, len(tokens), pack(np.concatenate([place, tokens])), hashes[order].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, lengths, tokens, words = [], [], [], [], {}
        for batch in batches:
            for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = (text or "").encode().lower().split()
                if tokens and len(tokens) + len(found) > block:
                    yield row(number, ids, held, lengths, tokens, words)
                    number, ids, held, lengths, tokens, words = number + 1, [], [], [], [], {}
                tokens.extend([words.setdefault(w, len(words) + 2) for w in found])
                tokens.append(0)
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(found) + 1)
        if ids:
            yield row(number, ids, held, lengths, tokens, words)

    fields = "block long, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, tokens long, codes binary, words binary"
    return docs.select("doc_id", (~learn).alias("held"), "text").mapInArrow(run, fields)


def _array(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _hashes(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The sorted word hashes of a block."""
    return np.frombuffer(batch.column("words")[i].as_py(), np.uint64)


@dataclass
class Block:
    held: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Block:
        packed, tokens = unpack(batch.column("codes")[i].as_py()), batch.column("tokens")[i].as_py()
        place = packed[: len(packed) - tokens]
        return cls(_array(batch, "held", i), _array(batch, "lengths", i), place[packed[len(place) :]])

    @property
    def learned(self) -> np.ndarray:
        """Per token: whether its document is learned from."""
        return np.repeat(~self.held.astype(bool), self.lengths)

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)

    def histories(self, start: int) -> np.ndarray:
        """Per token: the place of the word before it."""
        before = np.empty(len(self.codes), dtype=np.int64)
        before[1:] = self.codes[:-1]
        before[self.starts] = start
        return before


@dataclass
class Pairs:
    """The distinct pairs of a block in the order of its questions, and each token's pair."""

    history: np.ndarray
    word: np.ndarray
    range: np.ndarray
    token: np.ndarray

    @classmethod
    def of(cls, block: Block, ids: np.ndarray, counts: np.ndarray, start: int, ranges: int, total: int) -> Pairs:
        keys, token = np.unique(block.histories(start) * len(ids) + block.codes, return_inverse=True)
        history, word = np.divmod(keys, len(ids))
        home = ids[history] % ranges
        spread = counts[history] * ranges > SPREAD * total
        place = np.where(spread, (ids[word] * 0x9E3779B1 >> 7) % ranges, home)
        order = np.argsort(place, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return cls(history[order], word[order], place[order], back[token])


def _slices(places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal numbers in a sorted array: number, begin, end."""
    cuts = np.flatnonzero(np.diff(places)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
        if b > a:
            yield int(places[a]), a, b


def pack(values: np.ndarray | None) -> bytes | None:
    """Numbers as compressed bytes: whole ones as differences in the fewest bytes that hold them, exactly."""
    if values is None:
        return None
    values = np.asarray(values)
    if values.dtype.kind == "f":
        return b"d" + zstandard.ZstdCompressor(level=1).compress(values.astype(np.float64).tobytes())
    values = values.astype(np.int64)
    steps = np.diff(values, prepend=np.int64(0))
    best = b""
    for mark, numbers in ((b"v", values.view(np.uint64)), (b"s", ((steps << 1) ^ (steps >> 63)).view(np.uint64))):
        most = int(numbers.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
        # Bytes of equal weight stand together, so that the high ones shrink to nothing.
        planes = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
        found = mark + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        best = found if not best or len(found) < len(best) else best
    return best


def unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed[1 if packed[:1] == b"d" else 2 :])
    if packed[:1] == b"d":
        return np.frombuffer(raw, np.float64)
    width = packed[1]
    planes = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T)
    numbers = planes.reshape(-1).view(f"<u{width}").astype(np.uint64)
    if packed[:1] == b"v":
        return numbers.view(np.int64)
    steps = (numbers >> np.uint64(1)).view(np.int64) ^ -(numbers & np.uint64(1)).view(np.int64)
    return np.cumsum(steps)


FIELDS = "kind int, range int, block long, a binary, b binary, c binary, d binary, s binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in "abcds"]])
#: Kinds of rows between blocks and ranges.
ASK, ANSWER, TABLE, HISTORY, COUNTS = range(5)


def _row(kind: int, place: int, block: int, a=None, b=None, c=None, d=None, s=None) -> tuple:
    return kind, place, block, pack(a), pack(b), pack(c), pack(d), pack(s)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def _columns(table: pa.Table, name: str, rows: list[int]) -> list[np.ndarray]:
    column = table[name]
    return [unpack(column[i].as_py()) for i in rows]


def _at_ranges(rows: DataFrame, answer) -> DataFrame:
    """Runs ``answer`` (a table in, rows out) in one task per range."""
    return rows.groupBy("range").applyInArrow(lambda t: pa.Table.from_batches([_batch(list(answer(t)))], SCHEMA), FIELDS)


def _for_blocks(answers: DataFrame, name: str, *columns: str) -> DataFrame:
    """Per block its answers, in the order of the ranges."""
    parts = F.sort_array(F.collect_list(F.struct("range", *columns)))
    return answers.groupBy("block").agg(parts.alias(name))


def _joined(batch: pa.RecordBatch, name: str, column: str, i: int) -> np.ndarray:
    """One column of a block's answers, end to end."""
    parts = batch.column(name)[i].values
    arrays = [unpack(x.as_py()) for x in parts.field(column)] if len(parts) else []
    return np.concatenate(arrays) if arrays else np.empty(0)


# --- the three questions ----------------------------------------------------------------------------


def _ask_words(blocks: DataFrame, ranges: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, words = Block.of(batch, i), _hashes(batch, i)
                learned = block.learned
                counts = np.bincount(block.codes[learned], minlength=len(words))
                counts[np.searchsorted(words, START)] = int((~block.held.astype(bool)).sum())
                places = ((words >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                number = batch.column("block")[i].as_py()
                yield _batch([_row(ASK, p, number, a=words[x:y].view(np.int64), c=counts[x:y]) for p, x, y in _slices(places)])

    return blocks.select("block", "held", "lengths", "tokens", "codes", "words").mapInArrow(run, FIELDS)


def _answer_words(table: pa.Table, ranges: int) -> Iterator[tuple]:
    """Ids and counts of the words of a range; an id holds the range and the word's place in it."""
    place, rows = table["range"][0].as_py(), list(range(table.num_rows))
    keys, counts = _columns(table, "a", rows), _columns(table, "c", rows)
    words, at = np.unique(np.concatenate(keys).view(np.uint64), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(words)).astype(np.int64)
    begin = 0
    for i, k in zip(rows, keys, strict=True):
        own = at[begin : begin + len(k)]
        begin += len(k)
        yield _row(ANSWER, place, table["block"][i].as_py(), a=own * ranges + place, c=total[own])
    real = (total > 0) & (words != START)
    yield _row(TABLE, place, -1, a=words[real].view(np.int64), b=total[real])
    few = np.bincount(np.minimum(total[real], TRUSTED + 2), minlength=TRUSTED + 3)
    yield _row(COUNTS, place, -1, b=[*few.tolist(), int(total[real].sum())])


def _ask_pairs(blocks: DataFrame, ranges: int, total: int) -> DataFrame:
    def ask(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        block = Block.of(batch, i)
        ids, counts = _joined(batch, "known", "a", i), _joined(batch, "known", "c", i)
        start = int(np.searchsorted(_hashes(batch, i), START))
        pairs = Pairs.of(block, ids, counts, start, ranges, total)
        n = np.bincount(pairs.token[block.learned], minlength=len(pairs.word))
        rows = []
        for p, x, y in _slices(pairs.range):
            history, word = pairs.history[x:y], pairs.word[x:y]
            first = np.append([0], np.flatnonzero(np.diff(history)) + 1)
            size = np.diff(np.append(first, len(history))).astype(np.int32)
            rows.append(_row(ASK, p, batch.column("block")[i].as_py(), a=ids[history[first]], b=ids[word], c=np.concatenate([counts[word], n[x:y]]), d=size))
        return _batch(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield ask(batch, i)

    return blocks.mapInArrow(run, FIELDS)


def _answer_pairs(unigrams: Unigrams, ranges: int):
    def answer(table: pa.Table) -> Iterator[tuple]:
        place, rows = table["range"][0].as_py(), list(range(table.num_rows))
        sizes = _columns(table, "d", rows)
        history = np.concatenate([np.repeat(a, d) for a, d in zip(_columns(table, "a", rows), sizes, strict=True)])
        words = _columns(table, "b", rows)
        word = np.concatenate(words)
        both = [c.reshape(2, -1) for c in _columns(table, "c", rows)]
        of_word, n = np.concatenate([c[0] for c in both]), np.concatenate([c[1] for c in both])
        order = np.lexsort([word, history])
        new = np.append([True], (np.diff(history[order]) != 0) | (np.diff(word[order]) != 0))
        group = np.cumsum(new) - 1
        totals = np.bincount(group, weights=n[order]).astype(np.int64)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = group
        begin = 0
        for i, w in zip(rows, words, strict=True):
            yield _row(ANSWER, place, table["block"][i].as_py(), c=totals[back[begin : begin + len(w)]])
            begin += len(w)
        first = order[new]
        seen = totals > 0
        h, w, c, share = history[first][seen], word[first][seen], totals[seen], unigrams.probability(of_word[first][seen].astype(np.int64))
        few = np.bincount(np.minimum(c, TRUSTED + 2), minlength=TRUSTED + 3)
        yield _row(COUNTS, place, -1, b=few.tolist())
        if not len(h):
            return
        starts = np.append([0], np.flatnonzero(np.diff(h)) + 1)
        yield _row(TABLE, place, -1, a=h[starts], b=w, c=c, d=np.diff(np.append(starts, len(h))))
        parts = [np.add.reduceat((c == r).astype(np.int64), starts) for r in range(1, TRUSTED + 1)]
        parts.append(np.add.reduceat(np.where(c > TRUSTED, c, 0), starts))
        table_of, sums = np.stack(parts), np.add.reduceat(share, starts)
        home = h[starts] % ranges
        by_home = np.argsort(home, kind="stable")
        for p, x, y in _slices(home[by_home]):
            own = by_home[x:y]
            yield _row(HISTORY, p, -1, a=h[starts][own], b=table_of[:, own].ravel(), s=sums[own])

    return answer


def _answer_weights(factors: np.ndarray):
    """Backoff weights; negative where no count was discounted, so that totals count one more."""

    def answer(table: pa.Table) -> Iterator[tuple]:
        place, kinds = table["range"][0].as_py(), table["kind"].to_pylist()
        rows = [i for i, k in enumerate(kinds) if k == HISTORY]
        ids, weights = np.empty(0, dtype=np.int64), np.empty(0)
        if rows:
            every = np.concatenate(_columns(table, "a", rows))
            parts = np.concatenate([b.reshape(TRUSTED + 1, -1) for b in _columns(table, "b", rows)], axis=1)
            ids, at = np.unique(every, return_inverse=True)
            counts = np.stack([np.bincount(at, weights=x, minlength=len(ids)) for x in parts])
            share = np.bincount(at, weights=np.concatenate(_columns(table, "s", rows)), minlength=len(ids))
            r = np.arange(1, TRUSTED + 1)[:, None]
            total = (r * counts[:-1]).sum(axis=0) + counts[-1]
            lost = ((1 - factors[1 : TRUSTED + 1])[:, None] * r * counts[:-1]).sum(axis=0)
            none = lost <= 0
            weights = np.where(none, -1 / (total + 1), lost / total) / np.maximum(1 - share, 1e-300)
            yield _row(TABLE, place, -1, a=ids, s=weights)
        for i in (i for i, k in enumerate(kinds) if k == ANSWER):
            own = unpack(table["a"][i].as_py())
            at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
            found = weights[at] if len(ids) else np.ones(len(own))
            known = ids[at] == own if len(ids) else np.zeros(len(own), dtype=bool)
            yield _row(ANSWER, place, table["block"][i].as_py(), s=np.where(known, found, 1.0))

    return answer


OUTPUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(blocks: DataFrame, ranges: int, train_tokens: int, unigrams: Unigrams, factors: np.ndarray) -> DataFrame:
    names = [f.split()[0] for f in OUTPUT.split(", ")]

    def score(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        block = Block.of(batch, i)
        ids, counts = _joined(batch, "known", "a", i), _joined(batch, "known", "c", i).astype(np.int64)
        start = int(np.searchsorted(_hashes(batch, i), START))
        pairs = Pairs.of(block, ids, counts, start, ranges, train_tokens)
        n, weights = _joined(batch, "pairs", "c", i).astype(np.int64), _joined(batch, "weights", "s", i)
        plain = unigrams.probability(counts)
        of_history = counts[pairs.history] + (weights[pairs.history] < 0)
        bigram = factors[np.minimum(n, TRUSTED + 1)] * n / np.maximum(of_history, 1)
        backed = np.abs(weights[pairs.history]) * plain[pairs.word]
        logs = np.log10(np.where(n > 0, bigram, backed))
        base = np.log10((counts + 1) / (train_tokens + unigrams.words + 1))
        at = block.starts
        columns = [
            batch.column("doc_ids")[i].values,
            pa.array(block.held),
            pa.array(block.lengths),
            pa.array(np.add.reduceat((counts > 0).astype(np.int64)[block.codes], at)),
            pa.array(np.full(len(at), train_tokens, dtype=np.int64)),
            pa.array(np.add.reduceat(base[block.codes], at)),
            pa.array(np.add.reduceat(logs[pairs.token], at)),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield score(batch, i)

    return blocks.mapInArrow(run, OUTPUT)


def _counts(answers: DataFrame) -> tuple[dict[int, int], int, int]:
    """Counts of counts up to ``TRUSTED`` + 1, their number and, of words, the sum of all counts: one row per range."""
    rows = answers.filter(F.col("kind") == COUNTS).select("b").collect()
    sums = np.sum([unpack(bytes(r["b"])) for r in rows], axis=0).tolist() if rows else [0] * (TRUSTED + 4)
    return {r: int(sums[r]) for r in range(1, TRUSTED + 2)}, int(sum(sums[1 : TRUSTED + 3])), int(sums[-1])


def _bucketed(df: DataFrame, folder: str, key: str, buckets: int) -> DataFrame:
    """Stored in the shared folder by buckets of a key, so that joins on it leave this side where it is."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{folder}/{name}").bucketBy(buckets, key).saveAsTable(name)
    stored_by_key = spark.table(name)
    stored_by_key.schema  # noqa: B018  resolved before its entry goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return stored_by_key


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, block: int = BLOCK) -> DataFrame:
    """Scores of all documents under a model of those that are not held out.

    ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigrams, one added to
    each count) and ``score``, both log10 of the text's probability.
    """
    spark = docs.sparkSession
    tasks, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_folder(spark)
    blocks = _bucketed(_encode(docs, ~held_out(F.col("doc_id"), modulus, remainder), block), folder, "block", 2 * tasks)
    # As many ranges as keep one bounded, whatever the number of tokens.
    ranges = max(tasks, (blocks.agg(F.sum("tokens")).first()[0] or 0) // RANGE)

    answers = stored(_at_ranges(_ask_words(blocks, ranges), lambda t: _answer_words(t, ranges)), folder, "unigrams", "kind")
    few, words, total = _counts(answers)
    unigrams = unigrams_of(few, total, words)
    told = answers.filter(F.col("kind") == ANSWER)
    known = _for_blocks(told, "known", "a", "c")
    asked = _ask_pairs(blocks.join(known, "block"), ranges, total)

    found = stored(_at_ranges(asked, _answer_pairs(unigrams, ranges)), folder, "pairs", "kind")
    factors = discounts(_counts(found)[0])
    histories = found.filter(F.col("kind") == HISTORY).unionByName(told.withColumn("c", F.lit(None).cast("binary")))
    weights = stored(_at_ranges(histories, _answer_weights(factors)), folder, "weights", "kind")

    ready = blocks.join(known, "block")
    ready = ready.join(_for_blocks(found.filter(F.col("kind") == ANSWER), "pairs", "c"), "block")
    ready = ready.join(_for_blocks(weights.filter(F.col("kind") == ANSWER), "weights", "s"), "block")
    return _score(ready, ranges, total, unigrams, factors)
