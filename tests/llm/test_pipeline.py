"""The pipeline against a plain version of every stage, and the registration."""

import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from tankline.llm.language_id import LETTERS, LONGEST, fit
from tankline.llm.mixing import mix
from tankline.llm.packing import pieces_of
from tankline.llm.quality_rules import STOP_WORDS
from tests.llm.data import edge_rows, rows_of, table, text
from tests.llm.test_rules_and_mixing import measured
from tests.llm.test_similarity_and_model import plain_components
from tests.llm.test_texts import ids

SF = "/root/testdata/sf0.001"
TABLES = "documents pages labels benchmark conversations embeddings".split()


def plain_keep(text) -> bool:
    words, chars, symbols, repeated_lines, repeated = measured(text)
    lines = sum(1 for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    if words < 50 or 100 * repeated > 50 * words:
        return False
    stops = sum(w in STOP_WORDS for w in re.findall(r"[^\x20\x09-\x0D]+", text))
    return 2 <= chars / words <= 14 and symbols / words <= 0.25 and stops / words >= 0.01 and repeated_lines / max(1, lines) <= 0.5


def plain_language(model, text) -> tuple[str, float]:
    """Word by word and character by character."""
    words = LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    total = np.zeros(len(model.languages))
    for w in words:
        if w in model.words:
            total += model.word_scores[model.words[w]]
            continue
        marked, rows = f"<{w}>", []
        for i in range(len(marked) - 1):
            rows.append(next((model.grams[marked[i : i + n]] for n in range(LONGEST, 0, -1) if marked[i : i + n] in model.grams), 0))
        total += np.mean([model.gram_scores[r].astype(float) for r in rows], axis=0)
    mean = total / len(words)
    share = [math.exp((m - mean.max()) * min(len(words), 12)) for m in mean]
    return model.languages[int(mean.argmax())], max(share) / sum(share)


def test_stages_equal_their_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    good = stages["quality rules"](spark, docs, SF)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in rows_of(good)} == {r["doc_id"] for r in rows_of(docs) if plain_keep(r["text"])}

    known = stages["language id"](spark, good, SF)
    model = fit(good.filter(~cp.held_out(good["doc_id"], 5, 0)))
    want = {r["doc_id"] for r in rows_of(good) if (x := plain_language(model, r["text"]))[0] != "und" and x[1] >= cp.SURE}
    assert known.columns == docs.columns and {r["doc_id"] for r in rows_of(known)} == want

    unique = stages["near duplicates"](spark, known, SF)
    parts = plain_components([(r["doc_id"], r["text"]) for r in rows_of(known)])
    firsts = {int(d) for d, _, c in (re.findall(r"-?\d+", p) for p in parts) if d == c}
    assert unique.columns == docs.columns and {r["doc_id"] for r in rows_of(unique)} == firsts

    mixed = stages["mixing"](spark, unique, SF)
    taken = {r["doc_id"]: r["taken"] for r in rows_of(mix(unique))}
    words = Counter()
    for r in rows_of(mixed):
        words[r["doc_id"]] += len(r["text"].split())
    assert mixed.columns == docs.columns and dict(words) == {d: n for d, n in taken.items() if n}

    packed = rows_of(stages["packing"](spark, mixed, SF))
    want = Counter()
    for r in rows_of(mixed):
        own = ids(r["text"]) + np.array([2], dtype="<u4").tobytes()
        for k, (start, length) in enumerate(pieces_of(len(own) // 4)):
            want[r["doc_id"], k, start, length, zlib.crc32(own[4 * start : 4 * (start + length)])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * math.ceil(sum(fill.values()) / 1024) + 2

    whole = entry.queries()["pipeline"](spark, SF)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert Counter(tuple(r.values())[:5] for r in rows_of(whole)) == want


def test_stages_keep_clashing_columns_and_survive_edges(spark):
    docs = table(spark, edge_rows())
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert cp.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    unique = rows_of(cp.one_of_each(spark, docs, SF))
    assert sorted(str(r["doc_id"]) for r in unique) == sorted(str(i) for i in [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, None])


def test_registration():
    names = list(entry.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] and {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11))
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


def test_rest_works_without_the_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['tankline', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name='.'.join(name.split('.')[:2]))\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'], list(e.queries())\n"
        "assert e.oracle_sql()\n"
    )
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})


@pytest.mark.parametrize("name", ["op4_quality_rules", "op5_jaccard_join", "op6_mixing"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, want.fetchall()))


def test_a_text_whose_id_stands_with_a_copy_stays(spark):
    a, b, c = (text(i, 60) for i in (1, 2, 3))
    docs = table(spark, [(3, a), (7, a), (7, b), (7, b), (8, c), (9, c + " end"), (None, a)])
    kept = rows_of(cp.one_of_each(spark, docs, SF))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("3", a), ("7", b), ("8", c), ("None", a)])


def test_small_shares_draw_in_proportion(spark):
    from tankline.llm.common import in_sample

    ids = spark.range(2_000_000)
    drawn = [ids.filter(in_sample(share, "seed", "id")).count() for share in (0, 1e-30, 2e-5, 0.25, 1, 3)]
    assert drawn[0] == drawn[1] == 0 and 10 < drawn[2] < 90 and 490_000 < drawn[3] < 510_000 and drawn[4] == drawn[5] == 2_000_000
    # A share of one in a hundred million still has a threshold of its own.
    plans = [str(ids.filter(in_sample(share, "seed", "id"))._jdf.queryExecution().optimizedPlan()) for share in (1e-8, 2e-8)]
    assert plans[0] != plans[1] and "false" not in plans[0].split("Filter")[1][:6]
