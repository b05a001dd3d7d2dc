"""Language identification that looks at words first and backs off to characters.

A known word adds its log frequency in each language. A word that was not learned is read at each of
its characters by the longest known n-gram that starts there, four characters first, then three, two
and one; the mean of their log frequencies stands for the word.

The model is fitted on a sample of labelled rows of bounded size (``SAMPLE`` documents, drawn by a hash
of the id), so its tables fit into a broadcast. All documents are then read whole.

Edge cases: texts that are NULL or hold no letter get ``und`` and score 0, and so does everything if no
row has a label; equal scores go to the first language by name; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import held_out, in_sample, tell_workers

#: Labelled documents that the model is fitted on, about.
SAMPLE = 8_000
#: A word or n-gram counts as known from this many occurrences on.
LEAST_WORD, LEAST_GRAM = 3, 3
LONGEST = 4
SMOOTHING = 0.5
#: Words that a document's score is based on at most, so that long texts do not all score 1.
EVIDENCE = 12
#: Words outside the model that a worker remembers before it starts anew.
REMEMBERED = 300_000
ROWS = 512
UNDETERMINED = "und"

LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Log frequencies: a row per word or n-gram, a column per language."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    unseen: dict[str, int] = field(default_factory=dict)
    unseen_scores: list[np.ndarray] = field(default_factory=list)

    def _gram_rows(self, word: str) -> list[int]:
        """The longest known n-gram at each character; row 0 where even the character is new."""
        text, rows, get = f"<{word}>", [], self.grams.get
        for i in range(len(text) - 1):
            for n in range(LONGEST, 0, -1):
                row = get(text[i : i + n])
                if row is not None:
                    rows.append(row)
                    break
            else:
                rows.append(0)
        return rows

    def _learn(self, words: list[str]) -> None:
        rows = [self._gram_rows(w) for w in words]
        starts = np.cumsum([0, *map(len, rows[:-1])])
        sums = np.add.reduceat(self.gram_scores[[r for each in rows for r in each]], starts)
        base = len(self.unseen)
        self.unseen.update((w, base + i) for i, w in enumerate(words))
        self.unseen_scores.append((sums / np.array([[len(r)] for r in rows])).astype(np.float32))

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if len(self.unseen) > REMEMBERED:
            self.unseen, self.unseen_scores = {}, []
        known, unseen = self.words, self.unseen
        new = list({w for words in split for w in words if w not in known and w not in unseen})
        if new:
            self._learn(new)
        table = np.concatenate([self.word_scores, *self.unseen_scores])
        self.unseen_scores = [table[len(self.word_scores) :]]
        shift = len(self.word_scores)
        rows = {w: shift + self.unseen[w] for words in split for w in words if w not in known}
        out = []
        for words in split:
            if not self.languages or not words or not (words[0].isalpha() or any(c.isalpha() for w in words for c in w)):
                out.append((UNDETERMINED, 0.0))
                continue
            at = [known[w] if w in known else rows[w] for w in words]
            mean = table[at].mean(axis=0, dtype=np.float64)
            share = np.exp((mean - mean.max()) * min(len(words), EVIDENCE))
            best = int(mean.argmax())
            out.append((self.languages[best], float(share[best] / share.sum())))
        return out


def _grams(word) -> F.Column:
    """All n-grams of a word between its marks, as an array."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    one = lambda n: F.transform(
        F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(marked, i, F.lit(n)),
    )
    return F.concat(*[one(n) for n in range(1, LONGEST + 1)])


def _table(rows: list, languages: list[str], key: str, total: dict) -> tuple[dict[str, int], np.ndarray]:
    """Row numbers and smoothed log frequencies of words, or of n-grams by length; row 0 stands for the unknown."""
    place = {x: i for i, x in enumerate(languages)}
    index: dict[str, int] = {"": 0}
    for r in rows:
        index.setdefault(r[key], len(index))
    counts = np.full((len(index), len(languages)), SMOOTHING)
    for r in rows:
        counts[index[r[key]], place[r["lang"]]] += r["n"]
    sizes = np.array([[total.get((x, len(k)), total.get((x, None), 0)) + SMOOTHING * len(index) for x in languages] for k in index]).reshape(len(index), len(languages))
    return index, np.log(counts / sizes).astype(np.float32)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns words and n-grams from about ``sample`` of the documents with a ``lang``."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, sample / max(1, labelled.count()))
    drawn = labelled.filter(in_sample(share, "language sample", "doc_id", "text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))
    counts = drawn.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.cache()
    try:
        totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()
        languages = sorted(r["lang"] for r in totals)
        frequent = counts.groupBy("word").agg(F.sum("n").alias("all")).filter(F.col("all") >= LEAST_WORD)
        word_rows = counts.join(frequent, "word").select("lang", "word", "n").collect()
        grams = counts.select("lang", F.explode(_grams(F.col("word"))).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        gram_rows = grams.filter(F.col("n") >= LEAST_GRAM).collect()
    finally:
        counts.unpersist()
    by_length: dict = {}
    for r in gram_rows:
        by_length[r["lang"], len(r["gram"])] = by_length.get((r["lang"], len(r["gram"])), 0) + r["n"]
    known, word_scores = _table(word_rows, languages, "word", {(r["lang"], None): r["n"] for r in totals})
    gram_index, gram_scores = _table(gram_rows, languages, "gram", by_length | {(x, None): 1 for x in languages})
    known.pop("")
    return Model(languages, known, word_scores, gram_index, gram_scores)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = shared.value.scores(part.column("_text").to_pylist())
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    tell_workers(docs.sparkSession)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{fields}, lang_pred string, score double")


def language_id(docs: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``; learns from documents that are not held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"), modulus, remainder)))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score")
