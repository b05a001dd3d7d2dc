"""Small tables for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, score double, kept int, run int, node long"
SYLLABLES = "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n)]


def text(seed: int, n: int = 80) -> str:
    return " ".join(words(seed, n)).capitalize() + "."


def table(spark, rows):
    """Documents from (doc_id, text[, lang, source]); further columns have names that operators use themselves."""
    full = [(i, t, *(rest + (None,) * (2 - len(rest))), None if t is None else len(t), 7, "w", 0.5, 1, 1, 1) for i, t, *rest in rows for rest in [tuple(rest)]]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows() -> list[tuple]:
    """NULLs in every column, empty and white texts, a very long one, ties and repeated rows."""
    long_text = text(99, 60_000)
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n\r ", "en", None),
        (4, "One", None, "a"),
        (5, long_text, "en", "b"),
        (6, text(6), "en", "b"),
        (7, text(6), "en", "b"),
        (7, text(6), "en", "b"),
        (8, "ä" * 400 + " ß ü 12 ## é", "de", "c"),
        (9, "x " * 3000, "en", "c"),
        (10, "Ünïcödé \U0001f600 " * 30, "fr", "c"),
        (11, "1 2 3 !!", "fr", "d"),
        (None, text(11), "en", "d"),
    ]


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]
