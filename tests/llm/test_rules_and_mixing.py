"""Quality rules and mixing: edges, brute force, plans."""

import re
from collections import Counter

import pytest

from tankline.llm.mixing import BLOCK, apportion, mix, mixed_documents
from tankline.llm.quality_rules import RULES, quality_rules
from tests.llm.data import edge_rows, rows_of, table, text, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain_counting(spark):
    rows = [*edge_rows(), (20, "a b c a b c x a b c\na b c\n\na b c", "en", "a"), (21, "a b c d a b c d a b c d", "en", "a"), (22, "<p> # $ & |\n#\n#", "en", "a")]
    df = quality_rules(table(spark, rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted(str((r["doc_id"], *(r[n] for n in names))) for r in rows_of(df))
    assert got == sorted(str((i, *measured(t))) for i, t, *_ in rows)


def test_verdict(spark):
    clean = "The " + text(1, 60) + " of the and that " * 3
    rows = [(1, clean), (2, clean.replace(" ", "%%% ")), (3, clean.upper()), (4, "the of and " * 30), (5, None)]
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rows_of(quality_rules(table(spark, rows)))}
    assert kept == {1: (False, True), 2: (False, False), 3: (False, False), 4: (True, False), 5: (True, False)}
    assert all(r.low < r.high for r in RULES)


def test_colliding_high_bits_fall_back_to_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tankline.llm import quality_rules as q

    few = lambda *c: F.pmod(F.hash(*c), F.lit(4)).cast("long")  # noqa: E731  hashes whose high bits are all alike
    t = " ".join(words(3, 40))
    want = rows_of(q.quality_rules(table(spark, [(1, "a b c d e a b c f a b c")])))[0]["n_repeat_words"]
    assert want == 9
    with monkeypatch.context() as m:
        m.setattr(q.F, "xxhash64", few)
        got = rows_of(q.quality_rules(table(spark, [(1, t)])))[0]["n_repeat_words"]
    w = t.split()
    keys = [r[0] for r in spark.createDataFrame([tuple(w[i : i + 3]) for i in range(len(w) - 2)], "a string, b string, c string").select(few("a", "b", "c")).collect()]
    n = Counter(keys)
    assert got == len({i + k for i, x in enumerate(keys) if n[x] > 1 for k in range(3)})


def test_rules_run_without_python_or_shuffle(spark):
    plan = quality_rules(table(spark, edge_rows()[:4]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 997])
def test_apportionment_takes_highest_quotients(spark, seats):
    weights = {"a": 5.0, "b": 2.0, "c": 1.0, "d": 0.0, "e": 1.0, "f": 300.0, "g": 0.4}
    df = spark.createDataFrame([(0, k, w, seats) for k, w in weights.items()], "g int, k string, w double, seats long")
    got = {r["k"]: r["quota"] for r in rows_of(apportion(df, ["g"], ["k"], "w", "seats"))}
    quotients = sorted(((-w / (2 * n - 1), k) for k, w in weights.items() if w for n in range(1, seats + 1)))[:seats]
    assert got == {k: sum(x == k for _, x in quotients) for k in weights}


def test_mix_meets_targets(spark):
    rows = [(i, text(i, 20 + i % 90), "en", f"s{min(i % 9, 3)}" if i % 11 else None) for i in range(600)]
    got = rows_of(mix(table(spark, rows), shard=2_000))
    assert len(got) == 600 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {(r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in targets) == pytest.approx(total)
    assert all(t <= 3 * s for s, t in targets)
    for size, target in targets:
        assert abs(sum(r["taken"] for r in got if r["source_size"] == size) - target) < 3 * BLOCK
    again = rows_of(mix(table(spark, rows[::-1]).repartition(5), shard=2_000))
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_edges(spark):
    got = rows_of(mix(table(spark, edge_rows())))
    assert len(got) == len(edge_rows())
    assert all(r["size"] == len(WORD.findall(t or "")) for (i, t, *_) in edge_rows() for r in got if r["doc_id"] == i)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert rows_of(mix(table(spark, edge_rows()[:3])))[0]["target"] == 0.0


def test_mixed_documents_hold_the_words_taken(spark):
    docs = table(spark, [(i, text(i, 50 + i), "en", "ab"[i % 2]) for i in range(40)])
    taken = {r["doc_id"]: r["taken"] for r in rows_of(mix(docs))}
    found = Counter()
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    for r in rows_of(out):
        found[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert dict(found) == {i: n for i, n in taken.items() if n}


def test_empty_tables(spark):
    empty = table(spark, edge_rows()).limit(0)
    assert rows_of(quality_rules(empty)) == [] and rows_of(mix(empty)) == [] and rows_of(mixed_documents(empty)) == []
