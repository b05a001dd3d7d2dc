"""Quality classifier trained by two views that teach each other.

One classifier sees only the content of a text, the other only what is known about it: source, language and
stored length. Both start from labelled documents. In each round each view labels the documents of
an unlabelled pool that it is surest about, in the proportion of the classes, and these join the
other view's training rows. At the end each view's score is calibrated on labelled rows that neither
was trained on, and a logistic regression of both calibrated views scores every document.

Training rows are samples of bounded size (``LABELLED``, ``POOL``, drawn by hashes of the id); what the
driver sees of them is a row of numbers per document. All documents are then read whole.

Edge cases: NULL and empty texts are scored as texts without words; NULL metadata is a value of its
own; without labels of both classes every score is the share of good labels, or 0.5 without
any; repeated label rows count as good if one of them does; an empty table gives an empty result;
columns other than those named are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import held_out, in_sample, map_rows

LABELLED, POOL = 8_000, 16_000
ROUNDS, SURE, LEARNED = 5, 0.9, 400
KEEP = 0.5
BUCKETS = 32
RIDGE = 1.0

# Character classes of bytes: lower, upper, digit, blank, line end, ordinary punctuation, other ASCII, beyond ASCII.
CLASSES = np.full(256, 6, dtype=np.int64)
CLASSES[ord("a") : ord("z") + 1] = 0
CLASSES[ord("A") : ord("Z") + 1] = 1
CLASSES[ord("0") : ord("9") + 1] = 2
CLASSES[[32, 9, 11, 12, 13]] = 3
CLASSES[10] = 4
CLASSES[[ord(c) for c in ".,;:'\"-?()"]] = 5
CLASSES[128:] = 7


def text_view(text: str | None) -> list[float]:
    """Numbers about the content of a text; shares are of its bytes, words or lines."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    shares = np.bincount(CLASSES[data], minlength=8) / max(1, len(data))
    words = (text or "").split()
    n, counts = max(1, len(words)), Counter(words)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    pairs = max(1, len(words) - 1)
    return [
        *shares.tolist(),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / pairs,
        sum(1 for w in words if len(w) <= 3) / n,
        sum(1 for w in words if w.isalpha()) / n,
        np.log1p(len(words) / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
    ]


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Numbers about a document's metadata: hashed source and language, and the stored length in steps."""
    spots = np.zeros(2 * BUCKETS + 12)
    spots[xxhash.xxh3_64_intdigest(repr(source).encode()) % BUCKETS] = 1
    spots[BUCKETS + xxhash.xxh3_64_intdigest(repr(lang).encode()) % BUCKETS] = 1
    length = 0 if n_chars is None else min(10, int(np.log2(max(1, n_chars)) / 1.5))
    spots[2 * BUCKETS + (11 if n_chars is None else length)] = 1
    return spots.tolist()


@dataclass
class Logistic:
    """Ridge logistic regression on standardized features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def train(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> Logistic:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    weights = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        gradient = z.T @ (y - p) - penalty * weights
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        weights += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return Logistic(mean, scale, weights)


def surest(scores: np.ndarray, free: np.ndarray, good: float, most: int = LEARNED, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Pool rows that a view labels in one round, and their labels: the surest of each class, in the classes' proportion."""
    rows = np.flatnonzero(free)
    picked, labels = [], []
    for label, share in ((1.0, good), (0.0, 1 - good)):
        p = scores[rows] if label else 1 - scores[rows]
        order = rows[np.argsort(-p, kind="stable")][: max(1, round(most * share))]
        order = order[(scores[order] if label else 1 - scores[order]) >= sure]
        picked.append(order)
        labels.append(np.full(len(order), label))
    return np.concatenate(picked), np.concatenate(labels)


@dataclass
class Model:
    text: Logistic | None = None
    metadata: Logistic | None = None
    text_calibration: Logistic | None = None
    metadata_calibration: Logistic | None = None
    both: Logistic | None = None
    share: float = 0.5

    def views(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The calibrated logits of both views."""
        a = self.text_calibration.logit(self.text.logit(x)[:, None])
        b = self.metadata_calibration.logit(self.metadata.logit(m)[:, None])
        return np.column_stack([a, b])

    def scores(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, both."""
        if self.both is None or not len(x):
            return np.full((len(x), 3), self.share)
        views = self.views(x, m)
        return np.column_stack([1 / (1 + np.exp(-views)), self.both.score(views)])


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, pool_x: np.ndarray, pool_m: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``x`` and ``m`` are the views of labelled rows, ``y`` their labels; every fourth row is kept for calibration."""
    good = float(y.mean()) if len(y) else 0.5
    aside = np.arange(len(y)) % 4 == 3
    if any(len(set(part.tolist())) < 2 for part in (y[aside], y[~aside])):
        return Model(share=good)
    sets = {view: [data[~aside], y[~aside]] for view, data in (("text", x), ("metadata", m))}
    pools = {"text": pool_x, "metadata": pool_m}
    free = {view: np.ones(len(pool_x), dtype=bool) for view in sets}
    for _ in range(rounds):
        views = {view: train(*rows) for view, rows in sets.items()}
        for teacher, pupil in (("text", "metadata"), ("metadata", "text")):
            if not free[pupil].any():
                continue
            rows, labels = surest(views[teacher].score(pools[teacher]), free[pupil], good)
            free[pupil][rows] = False
            sets[pupil] = [np.concatenate([sets[pupil][0], pools[pupil][rows]]), np.concatenate([sets[pupil][1], labels])]
    model = Model(train(*sets["text"]), train(*sets["metadata"]), share=good)
    model.text_calibration = train(model.text.logit(x[aside])[:, None], y[aside])
    model.metadata_calibration = train(model.metadata.logit(m[aside])[:, None], y[aside])
    model.both = train(model.views(x[aside], m[aside]), y[aside])
    return model


def _views(text: list, source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([text_view(t) for t in text], dtype=np.float64)
    m = np.array([metadata_view(*row) for row in zip(source, lang, n_chars, strict=True)], dtype=np.float64)
    return x, m


COLUMNS = ("text", "source", "lang", "n_chars")


def _sampled(df: DataFrame, name: str, share: float) -> DataFrame:
    return df.filter(in_sample(share, name, "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Learns from about ``labelled`` labelled documents and a pool of at most about ``pool`` others, none of them among those."""
    labels = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = _sampled(labels, "quality sample", labelled / max(1, labels.count()))
    known = docs.select("doc_id", *COLUMNS).join(F.broadcast(drawn), "doc_id")
    others = _sampled(docs.select("doc_id", *COLUMNS), "quality pool", pool / max(1, docs.count()))
    others = others.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_anti").withColumn("quality", F.lit(None).cast("int"))
    names = [f"x{i}" for i in range(len(text_view(None)))] + [f"m{i}" for i in range(len(metadata_view(None, None, None)))]

    def numbers(ids: list, text: list, source: list, lang: list, n_chars: list, quality: list) -> tuple[list, ...]:
        x, m = _views(text, source, lang, n_chars)
        return (ids, quality, *x.T.tolist(), *m.T.tolist())

    fields = "doc_id long, quality int, " + ", ".join(f"{n} double" for n in names)
    rows = map_rows(known.unionByName(others).select("doc_id", *COLUMNS, "quality"), fields, numbers).toPandas()
    rows = rows.sort_values(["doc_id", "quality"], kind="stable", ignore_index=True)
    data = rows[names].to_numpy()
    width, has = len(text_view(None)), rows["quality"].notna().to_numpy()
    y = (rows["quality"][has] == 1).to_numpy(dtype=float)
    return co_train(data[has, :width], data[has, width:], y, data[~has, :width], data[~has, width:])


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 1, keep: float = KEEP) -> DataFrame:
    """``doc_id``, ``held_out``, both views' scores, ``score`` and ``kept``; learns from labels that are not held out."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"), modulus, remainder)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(ids: list, text: list, source: list, lang: list, n_chars: list) -> tuple[list, ...]:
        return (ids, *shared.value.scores(*_views(text, source, lang, n_chars)).T.tolist())

    fields = "doc_id long, text_score double, metadata_score double, score double"
    scored = map_rows(docs.select("doc_id", *COLUMNS), fields, score)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text_score", "metadata_score", "score", (F.col("score") >= keep).alias("kept")
    )
