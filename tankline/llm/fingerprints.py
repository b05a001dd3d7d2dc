"""Document fingerprints from content-defined chunks.

A gear hash runs over the UTF-8 bytes of a text; where its top bits are zero, a chunk may end.
Chunk sizes are normalised: below the normal size more bits must be zero, above it fewer. The hash
looks back over 32 bytes only and no chunk is shorter, so a chunk's end depends on nothing before
the chunk and inserted text shifts boundaries only nearby. A fingerprint is the set of chunk
digests, each with the chunk's length; containment is the share of one fingerprint's length whose
digests stand in the other.

Edge cases: NULL text counts as empty; an empty text has no chunks and the fingerprint ``""``,
and is alike (1.0) to another empty text and unlike (0.0) to any other; equal ids are ordered by
text; NULL ids come last in the order of documents; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import tell_workers

WINDOW = 32
#: One 32-bit number per byte value, drawn from a hash stream.
GEAR = np.frombuffer(hashlib.shake_128(b"gear table").digest(1024), dtype="<u4").astype(np.uint32)
#: Bytes hashed at a time; longer texts are hashed in pieces that overlap by the window.
PIECE = 1 << 21
#: Rows and bytes of text that a task turns into chunks at a time.
ROWS = 256

Fingerprint = dict[int, int]


@dataclass(frozen=True)
class Sizes:
    """Chunk sizes in bytes, and the zero bits asked for below and above the normal size."""

    least: int = 32
    normal: int = 64
    most: int = 512
    strict_bits: int = 7
    loose_bits: int = 5


def _hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' numbers, each shifted by its age."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
        step *= 2
    return h


def _boundaries(data: np.ndarray, sizes: Sizes) -> tuple[list[int], list[bool]]:
    """Places where a chunk may end, and whether each also holds below the normal size."""
    places, strict = [], []
    for begin in range(0, len(data), PIECE):
        back = min(begin, WINDOW - 1)
        h = _hashes(data[begin - back : begin + PIECE])[back:]
        at = np.flatnonzero(h < np.uint32(1 << (32 - sizes.loose_bits)))
        places += (at + (begin + 1)).tolist()
        strict += (h[at] < np.uint32(1 << (32 - sizes.strict_bits))).tolist()
    return places, strict


def chunk_spans(texts: list[bytes], sizes: Sizes = Sizes()) -> list[list[tuple[int, int]]]:
    """The chunks (begin, end) of each text, in bytes."""
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    places, strict = _boundaries(joined, sizes)
    places.append(len(joined) + sizes.most + 1)
    strict.append(False)
    found, k, start = [], 0, 0
    for text in texts:
        base, end, spans = start, start + len(text), []
        while start < end:
            first, normal, last = start + sizes.least, start + sizes.normal, min(start + sizes.most, end)
            while places[k] < first:
                k += 1
            cut, j = last, k
            while places[j] < last:
                if strict[j] or places[j] >= normal:
                    cut = places[j]
                    break
                j += 1
            spans.append((start - base, cut - base))
            start, k = cut, j
        found.append(spans)
    return found


def fingerprints(texts: list[bytes], sizes: Sizes = Sizes()) -> list[Fingerprint]:
    """The chunk digests of each text with the chunks' lengths."""
    digest = xxhash.xxh3_64_intdigest
    return [{digest(text[a:b]): b - a for a, b in spans} for text, spans in zip(texts, chunk_spans(texts, sizes), strict=True)]


def containment(a: Fingerprint, b: Fingerprint) -> float:
    """The share of ``a``'s length whose chunks are also in ``b``."""
    if not a or not b:
        return float(a == b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def as_text(fingerprint: Fingerprint) -> str:
    """Digests in order, each with its length."""
    return " ".join(f"{d:016x}.{fingerprint[d]}" for d in sorted(fingerprint))


def document_fingerprints(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``doc_id`` and the ``chunks`` of its text: digest and length, in the order of the digests."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                prints = fingerprints([(t or "").encode() for t in part.column(1).to_pylist()], sizes)
                chunks = [[{"digest": f"{d:016x}", "length": p[d]} for d in sorted(p)] for p in prints]
                kind = pa.list_(pa.struct([("digest", pa.string()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chunks, kind)], ["doc_id", "chunks"])

    tell_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunks array<struct<digest: string, length: bigint>>")


def _dealt(docs: DataFrame) -> DataFrame:
    """Documents in descending runs of ids, one run per task, each followed by the first of the next run (``guest``).

    Cut points are quantiles of the ids. What the driver sees is one id per run, as many as there
    are shuffle partitions.
    """
    runs = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    shares = [i / runs for i in range(1, runs)]
    cuts = sorted(set(ids.approxQuantile("doc_id", shares, 1 / (4 * runs)))) if shares else []
    df = docs.withColumn("_at", F.col("doc_id").cast("double"))
    ids = ids.withColumn("_at", F.col("doc_id").cast("double"))
    if cuts:
        deal = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_at", outputCol="_cut")
        df, ids = (deal.setHandleInvalid("keep").transform(x) for x in (df, ids))
    else:
        df, ids = (x.withColumn("_cut", F.lit(0.0)) for x in (df, ids))
    run = F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_cut").cast("int") + 1)
    df, ids = df.withColumn("run", run), ids.withColumn("run", run)
    firsts = {r["run"]: r["first"] for r in ids.groupBy("run").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    above = {low: high for low, high in zip(order, [*order[1:], *order[:1]], strict=True)}
    top = max(order, default=0) + 1
    first = F.get(F.array(*[F.lit(firsts.get(r)).cast("long") for r in range(top)]), F.col("run"))
    target = F.get(F.array(*[F.lit(above.get(r)).cast("int") for r in range(top)]), F.col("run"))
    own = F.struct(F.col("run"), F.lit(False).alias("guest"))
    seat = F.when(F.col("doc_id").eqNullSafe(first), F.array(own, F.struct(target.alias("run"), F.lit(True).alias("guest"))))
    df = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.inline(F.coalesce(seat, F.array(own))))
    order_by = ["run", "guest", F.col("doc_id").desc_nulls_last(), "text"]
    return df.repartitionById(top, F.col("run")).sortWithinPartitions(*order_by)


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Fingerprints of each text and of its edited text, in whose second half stands the next document's beginning.

    The next document is the one with the next smaller id; after the smallest comes the greatest.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bool, str]]]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS).to_pydict()
                yield list(zip(part["run"], part["doc_id"], part["guest"], part["text"], strict=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: tuple | None = None
        for part in rows(batches):
            own = fingerprints([t.encode() for *_, t in part], sizes)
            pairs = []
            for row, mark in zip(part, own, strict=True):
                if open_row and open_row[0] == row[0]:
                    pairs.append((open_row[1], open_row[2], open_row[3], row[3], mark))
                open_row = None if row[2] else (row[0], row[1], row[3], mark)
            edits = []
            for _, text, _, following, _ in pairs:
                half = len(text) // 2
                edits.append((text[: len(text) - half] + following[:half]).encode())
            out = []
            for (doc_id, text, mark, _, next_mark), edit, changed in zip(pairs, edits, fingerprints(edits, sizes), strict=True):
                sha = hashlib.sha256(edit).hexdigest()
                out.append((doc_id, len(text), sha, as_text(mark), as_text(changed), containment(mark, changed), containment(mark, next_mark)))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), schema=schema)

    schema = pa.schema(list(zip(names, [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2, strict=True)))
    tell_workers(docs.sparkSession)
    return _dealt(docs.select("doc_id", "text")).select("run", "doc_id", "guest", "text").mapInArrow(run, FIELDS)
