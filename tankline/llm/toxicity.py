"""Toxicity of texts whose words may be disguised.

A disguised word is taken for a plain word sent through a noisy channel: letters become digits or
signs, letters are repeated, and separators are put between them, also all at once. Each suspicious token is a lattice
of characters; a Viterbi search finds the path that a character trigram model and the channel
together make likeliest. Where it is open whether signs at the ends, doubled letters or digits belong to a disguise, a token
has both readings. The restored words are then scored by the log odds of the words that tell
toxic from other texts, and the sum is calibrated to a probability.

All tables are learned from all labelled documents: trigrams and words are counted by Spark, and the calibration's
sums, too, run over every labelled document. Every document is then read whole.

Edge cases: NULL and empty texts have no words and get the score of such a text; without any
labelled row the score is 0; repeated label rows count as toxic if one of them does; an empty
table gives an empty result; columns other than those named are ignored. The labelled texts and the odds of all
documents are stored in the shared folder.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import held_out, map_rows, shared_folder, stored

#: Words that the classifier looks at: the VOCABULARY with the greatest log-likelihood ratio, which is at least
#: STRONG, and whose log odds are at least APART.
VOCABULARY, STRONG, APART = 2_000, 24.0, 1.0
THRESHOLD = 0.3
REMEMBERED = 300_000

# What digits and signs stand for in disguised words.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "€": "e",
    "£": "l",
}
MASKS, MASKED = "*#", "aeiou"
SEPARATORS = " .-_*~'"
#: Log costs of the channel: a sign for a letter, a mask for a vowel, a dropped separator, a dropped repetition.
SIGN, MASK, GAP, AGAIN = -0.5, -1.5, -0.3, -0.5
#: Partial paths kept at each place of a lattice.
BEAM = 24

TRIPLE = re.compile(r"([^\W\d_])\1\1")
DOUBLE = re.compile(r"([^\W\d_])\1")
_SIGNS = re.escape("".join(x for x in (*LEET, *MASKS) if not x.isalnum()))
#: A letter, digit or sign (a * stands between them, or is one of them) that a separator, or punctuation and a blank, follows.
_ONE = rf"(?:[^\W_]|(?!\*)[{_SIGNS}])(?=[\s.\-_*~']|[^\w\s]*+(?:\s|\Z))"
_BETWEEN = r"[\s.\-_*~']++"
#: Single characters with separators between them. Nothing in it is tried in two ways, so its work is linear.
SPACED = re.compile(rf"(?<![^\s(\[\"'])(?:(?<!\*\s)(?:\*\s++)++)?+{_ONE}(?:{_BETWEEN}{_ONE})++(?:\s++\*(?!\S))*+")
#: What neither is a part of a word nor may stand for one, at the ends of a token.
AROUND = re.compile(rf"^(?:(?![{_SIGNS}])[\W_])++|(?:(?![{_SIGNS}])[\W_])++\Z")
EDGES = re.compile(r"^\W+|(\W)\1\1+$|[^\w$@€£]+$")


@dataclass
class CharacterModel:
    """Trigrams of characters within words: log probability of a character after two others."""

    trigrams: dict[str, int]
    bigrams: dict[str, int] = field(default_factory=dict)
    size: int = 1
    memory: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for gram, n in self.trigrams.items():
            self.bigrams[gram[:2]] = self.bigrams.get(gram[:2], 0) + n
        self.size = max(1, len({g[2] for g in self.trigrams}))

    def log(self, context: str, character: str) -> float:
        gram = context + character
        if gram not in self.memory:
            n = self.trigrams.get(gram, 0) + 0.05
            self.memory[gram] = math.log(n / (self.bigrams.get(context, 0) + 0.05 * (self.size + 1)))
        return self.memory[gram]


def restore(token: str, model: CharacterModel, beam: int = BEAM) -> str:
    """The likeliest plain word behind a token."""
    log = model.log
    paths: dict[str, tuple[float, str]] = {"^^": (0.0, "")}  # by the last two characters
    for c in token:
        if len(paths) == 1 and c.isalpha():
            [(context, (score, text))] = paths.items()
            if c != context[1]:
                paths = {context[1] + c: (score + log(context, c), text + c)}
                continue
        options = [(c, 0.0)] if c.isalpha() else [(x, SIGN) for x in LEET.get(c, "")]
        options += [(x, MASK) for x in MASKED] if c in MASKS else []
        dropped = c in SEPARATORS or not options
        step: dict[str, tuple[float, str]] = {}
        for context, (score, text) in paths.items():
            last = context[1]
            for x, cost in options:
                after, total = last + x, score + cost + log(context, x)
                if after not in step or step[after][0] < total:
                    step[after] = (total, text + x)
                if x == last:
                    total = score + cost + AGAIN
                    if context not in step or step[context][0] < total:
                        step[context] = (total, text)
            if dropped:
                total = score + GAP
                if context not in step or step[context][0] < total:
                    step[context] = (total, text)
        paths = dict(sorted(step.items(), key=lambda p: -p[1][0])[:beam]) if len(step) > 1 else step
    return max(((s + log(k, "$"), t) for k, (s, t) in paths.items()), default=(0.0, ""))[1]


def _long(span: str) -> bool:
    """Whether at least three characters of a word stand in it."""
    return sum(not x.isspace() and x not in ".-_~'" for x in span) > 2


@dataclass
class Restorer:
    """Finds the suspicious tokens of texts and remembers what they were restored to."""

    model: CharacterModel
    memory: dict[str, str] = field(default_factory=dict)
    readings: dict[str, tuple[str, ...]] = field(default_factory=dict)
    restored: dict[str, str] = field(default_factory=dict)

    def _restore(self, core: str) -> str:
        if core not in self.restored:
            if len(self.restored) > REMEMBERED:
                self.restored.clear()
            self.restored[core] = restore(core, self.model)
        return self.restored[core]

    def _word(self, token: str) -> str:
        if token not in self.memory:
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            core = EDGES.sub("", token)
            if token.startswith(tuple(LEET)) and core and core[0].isalpha() and not token[1:2].isspace():
                lead = re.match(r"\W+", token)
                core = (lead[0][-1] if lead and lead[0][-1] in LEET else "") + core
            plain = core.isalpha() and not TRIPLE.search(core)
            disguised = not plain and any(x.isalpha() for x in core)
            self.memory[token] = self._restore(core) if disguised else core
        return self.memory[token]

    def _readings(self, token: str) -> tuple[str, ...]:
        """The restored token, and what it is if all its signs, digits and repetitions are disguise."""
        if token not in self.readings:
            if len(self.readings) > REMEMBERED:
                self.readings.clear()
            if token.isalpha() and not DOUBLE.search(token):
                self.readings[token] = (token,)
                return self.readings[token]
            whole = AROUND.sub("", token)
            likely = self._word(token)
            disguised = not whole.isalpha() or DOUBLE.search(whole)
            self.readings[token] = (likely, self._restore(whole)) if whole and disguised else (likely,)
        return self.readings[token]

    def words(self, text: str | None) -> set[str]:
        """The distinct words of a text, plain and restored, in lower case."""
        low = (text or "").lower()
        tokens = set(low.split())
        found = {t for t in tokens if t.isalpha()}
        for token in tokens:
            found.update(self.readings.get(token) or self._readings(token))
        for span in SPACED.finditer(low):
            if _long(span[0]):
                found.update(self._readings(span[0]))
        found.discard("")
        return found

    def text(self, text: str) -> str:
        """The text with its disguised words restored."""
        low = SPACED.sub(lambda m: self._readings(m[0])[-1] if _long(m[0]) else m[0], text.lower())
        return " ".join(t if t.isalpha() and not TRIPLE.search(t) else self._word(t) for t in low.split())


@dataclass
class Model:
    characters: CharacterModel
    weights: dict[str, float]
    slope: float = 0.0
    intercept: float = -math.inf

    def __post_init__(self) -> None:
        self.restorer = Restorer(self.characters)
        self.vocabulary = frozenset(self.weights)

    def odds(self, text: str | None) -> float:
        return sum(self.weights[w] for w in sorted(self.vocabulary & self.restorer.words(text)))

    def score(self, odds: Column) -> Column:
        z = F.lit(self.intercept) + F.lit(self.slope) * odds
        return F.when(z > -700, 1 / (1 + F.exp(-z))).otherwise(0.0)


def calibrate(points: DataFrame, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one feature, by Newton steps with a small ridge.

    ``points`` has ``odds`` and how many rows of it are ``good`` and ``bad``. Every step sums over all of them, as decimals,
    so that the order of the sums changes nothing.
    """
    totals = points.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if totals["bad"] is None:
        return 0.0, -math.inf
    a, b = 0.0, math.log((totals["bad"] + 1) / (totals["good"] + 1))
    x, n = F.col("odds"), F.col("bad") + F.col("good")
    for _ in range(rounds):
        z = F.least(F.greatest(F.lit(a) * x + F.lit(b), F.lit(-30.0)), F.lit(30.0))
        p = 1 / (1 + F.exp(-z))
        w = n * F.greatest(p * (1 - p), F.lit(1e-9))
        r = F.col("bad") - n * p
        terms = {"rx": r * x, "r": r, "wxx": w * x * x, "wx": w * x, "w": w}
        sums = points.agg(*[F.sum(t.cast("decimal(38,16)")).alias(k) for k, t in terms.items()]).first()
        rx, r_, wxx, wx, w_ = map(float, sums)
        gradient = np.array([rx - 1e-3 * a, r_])
        hessian = np.array([[wxx + 1e-3, wx], [wx, w_ + 1e-3]])
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        a, b = float(a + step[0]), float(b + step[1])
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> tuple[Model, DataFrame]:
    """Learns from all labelled documents that are not held out; also gives ``doc_id`` and ``odds`` of every document.

    Labels and texts meet in a merge join, whatever their sizes: labels grow with the documents.
    """
    folder = shared_folder(docs.sparkSession)
    taught = ~held_out(F.col("doc_id"), modulus, remainder)
    labels = labels.filter(taught)
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    texts = docs.select("doc_id", "text").filter(taught)
    known = stored(texts.join(labels.hint("merge"), "doc_id").select("text", "toxic"), folder, "labelled")
    plain = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \t-\r]+"), lambda w: w.rlike(r"^\p{L}+$"))
    words = known.select(F.explode(plain).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    marked = F.concat(F.lit("^^"), F.col("word"), F.lit("$"))
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substring(marked, i, F.lit(3)))).alias("gram"), "n")
    trigrams = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").collect()}
    characters = CharacterModel(trigrams)
    restorer = known.sparkSession.sparkContext.broadcast(Restorer(characters))

    def counts(texts: list, toxic: list) -> tuple[list, list, list]:
        bad, good = Counter(), Counter()
        for text, t in zip(texts, toxic, strict=True):
            (bad if t else good).update(restorer.value.words(text))
        found = sorted(bad.keys() | good.keys())
        return found, [bad[w] for w in found], [good[w] for w in found]

    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    seen = map_rows(known, "word string, bad long, good long", counts, rows=2_048).groupBy("word")
    seen = seen.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    both = (F.col("bad") + F.col("good")) / (bad + good)
    term = lambda n, total: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (both * total))).otherwise(0.0)
    seen = seen.select("word", odds.alias("odds"), (2 * (term("bad", max(bad, 1)) + term("good", max(good, 1)))).alias("ratio"))
    seen = seen.filter((F.col("ratio") >= STRONG) & (F.abs("odds") >= APART))
    best = seen.orderBy(F.col("ratio").desc(), "word").limit(VOCABULARY).collect()
    model = Model(characters, {r["word"]: r["odds"] for r in best})
    shared = known.sparkSession.sparkContext.broadcast(model)
    each = map_rows(docs.select("doc_id", "text"), "doc_id long, odds double", lambda ids, texts: (ids, [shared.value.odds(t) for t in texts]))
    each = stored(each, folder, "odds")
    points = each.join(labels, "doc_id").groupBy("odds")
    points = points.agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    model.slope, model.intercept = calibrate(stored(points, folder, "points"))
    return model, each


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``; learns from labels of documents that are not held out."""
    model, odds = fit(docs, labels, modulus, remainder)
    return odds.select("doc_id", model.score(F.col("odds")).alias("score")).select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
