"""Quality rules: a table of thresholds, compiled into one projection.

``measures`` counts words, symbols, lines and repetitions of each text with built-in functions;
``verdict`` turns a table of ``Rule`` rows into one boolean expression over them. Nothing is
shuffled and no Python runs on the executors.

Edge cases: NULL and empty texts have no words, so every count is 0 and they fail the base rule;
repeated rows are judged one by one; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import barrier, words_of

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages, as they stand within a sentence.
STOP_WORDS = (
    "the of and to in is that for with it was on are be by this as from or an at not he his have but they which you we "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es wir aus bei nach "
    "le la les et des en un une du dans que qui pour est par sur au avec il elle pas ne ce nous "
    "el los las y del se por con no su para al lo como más pero sus una o este"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= over / per <= high``; ``per`` counts as 1 at least."""

    name: str
    over: str
    per: str
    low: float
    high: float


#: Names in ``over`` and ``per`` are columns of ``measures``; ``one`` stands for the number 1.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, 1.0),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _top(x: Column) -> Column:
    return F.call_function("shiftright", x, F.col("bits"))


def _with_repeats(df: DataFrame, keep: list[str]) -> DataFrame:
    """``n_repeat_words``: words covered by 3-word windows that stand twice or more in ``words``.

    Windows are 64-bit hashes. To sort plain numbers instead of pairs, a window is packed as its
    hash's high bits and its position; if two different hashes of a text meet in their high bits,
    that text is sorted as pairs.
    """
    size = F.size("words")
    third = F.slice("words", 3, F.greatest(size - 2, F.lit(0)))
    hashes = F.transform(third, lambda w, i: F.xxhash64(F.get("words", i), F.get("words", i + 1), w))
    df = barrier(df, keep, h=hashes, bits=F.length(F.bin(size.cast("long"))))
    bits = F.col("bits")
    packed = F.transform("h", lambda x, i: F.call_function("shiftleft", _top(x), bits) + i)
    df = barrier(df, [*keep, "h", "bits"], packed=F.sort_array(packed))

    def alike(x: Column, j: Column) -> Column:
        return (_top(F.get("packed", j - 1)) == _top(x)) | (_top(F.get("packed", j + 1)) == _top(x))

    def place(x: Column) -> Column:
        return x - F.call_function("shiftleft", _top(x), bits)

    df = barrier(df, [*keep, "h", "bits"], met=F.filter("packed", lambda x, j: F.coalesce(alike(x, j), F.lit(False))))
    differ = F.exists(
        F.transform(
            "met",
            lambda x, j: (_top(F.get("met", j + 1)) == _top(x)) & (F.get("h", place(F.get("met", j + 1)).cast("int")) != F.get("h", place(x).cast("int"))),
        ),
        lambda x: F.coalesce(x, F.lit(False)),
    )
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))))
    df = barrier(df, keep, places=F.transform("met", place), pairs=F.when(differ, pairs))

    def twice(z: Column, j: Column) -> Column:
        same = lambda k: F.coalesce(F.get("pairs", k)["x"] == z["x"], F.lit(False))
        return same(j - 1) | same(j + 1)

    exact = F.transform(F.filter("pairs", twice), lambda z: z["i"])
    df = barrier(df, keep, places=F.sort_array(F.when(F.col("pairs").isNull(), F.col("places")).otherwise(exact)))
    three = F.lit(3).cast("long")
    step = F.transform("places", lambda p, j: F.coalesce(F.least(three, F.get("places", j + 1) - p), three))
    return df.select(*keep, F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: the ``keep`` columns (``doc_id`` if none is named) and ``MEASURES``."""
    keep = keep or ("doc_id",)
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    text = F.col("_text")
    df = barrier(
        df,
        [*keep, "_text"],
        words=words_of(text),
        lines=F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]")),
    )
    counted = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.size(F.split(text, f"[{SYMBOLS}]")) - 1).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_stop_words": F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long"),
    }
    df = df.select(*keep, "words", *[c.alias(n) for n, c in counted.items()])
    df = _with_repeats(df, [*keep, *counted])
    return df.select(*keep, *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules as one expression: true where a row of ``measures`` passes them all."""

    def passes(r: Rule) -> Column:
        top = F.lit(1.0) if r.over == "one" else F.col(r.over).cast("double")
        per = F.lit(1.0) if r.per == "one" else F.greatest(F.col(r.per), F.lit(1)).cast("double")
        return (top / per).between(r.low, r.high)

    return reduce(lambda a, b: a & b, map(passes, rules), F.lit(True))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, measures, ``base_failed`` and ``kept``: the base holds and every rule passes."""
    df = measures(docs, *keep).withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))
