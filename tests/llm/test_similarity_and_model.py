"""Jaccard join, language model, co-training: brute force and edges."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tankline.llm import co_training as ct
from tankline.llm import jaccard_join as jj
from tankline.llm import language_model as lm
from tankline.llm.co_training import quality_scores, surest
from tankline.llm.components import components
from tests.llm.data import edge_rows, rows_of, table, text, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(t) -> list[bytes]:
    return [w.lower() for w in WORD.findall((t or "").encode())]


# --- similarity


def shingles(t) -> frozenset:
    w = tokens(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows) -> dict:
    sets = [shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least: dict = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(str((d, len(s), least.get(root(i)))) for i, ((d, *_), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed: int, n: int, edits: int, length: int = 120) -> list[str]:
    base, r = words(seed, length), np.random.default_rng(seed)
    out = []
    for k in range(n):
        w = list(base)
        for at in r.integers(0, length, size=edits):
            w[at] = f"edit{seed}x{k}x{at}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [4, 256])
def test_components_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(jj, "TILE", tile)
    texts = [text(i, 5 + i * 3) for i in range(40)]
    for seed in range(6):  # around the threshold: some link, some do not
        texts += near_copies(1000 + seed, 12, 1 + seed, 100 + 10 * seed)
    passage = " ".join(words(5, 60))
    texts += [f"{passage} {text(500 + i, 30)}" for i in range(20)]
    texts += [text(1, 8)] * 3 + [text(1, 8) + " x", "a b", "A b", "a b c d e", "a b c d e f"]
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)] + [(i, t) for i, t, *_ in edge_rows()]
    got = [str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in rows_of(jj.jaccard_classes(table(spark, rows)))]
    assert sorted(got) == plain_components(rows)


def test_chains_link_beyond_direct_neighbours(spark):
    w = words(9, 100)
    chain = [" ".join([*[f"new{k}" for k in range(4 * i)], *w[4 * i :]]) for i in range(12)]
    got = rows_of(jj.jaccard_classes(table(spark, list(enumerate(chain)))))
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == plain_components(list(enumerate(chain)))
    assert {r["component_id"] for r in got} == {0}


def test_tree_join_finds_every_admissible_pair():
    r = np.random.default_rng(1)
    for _ in range(20):
        points = r.poisson(r.integers(1, 4, size=(60, 1)), size=(60, 16)).astype(np.int32)
        sizes = points.sum(axis=1) + 1
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if np.minimum(points[i], points[j]).sum() >= -(-75 * (sizes[i] + sizes[j]) // 175)}
        got = [(min(a, b), max(a, b)) for i, j, _ in jj.admissible(points, sizes, leaf=4) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_bound_is_never_below_the_overlap():
    sets = jj.shingle_sets([*near_copies(3, 10, 8), text(1), text(2, 400)])
    for a in sets:
        for b in sets:
            assert np.minimum(jj.point(a), jj.point(b)).sum() >= len(np.intersect1d(a, b))


def test_component_rounds(spark, tmp_path):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (-5, 70)]
    got = {r["vertex"]: r["component"] for r in rows_of(components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path / "c"), "t"))}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, -5: -5, 70: -5}
    assert rows_of(components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "e"), "t")) == []


def test_a_copy_without_id_takes_no_links_from_its_class(spark):
    one, other = near_copies(77, 2, 1)
    rows = [(None, one), (5, one), (6, other)]
    got = rows_of(jj.jaccard_classes(table(spark, rows).coalesce(1)))
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == plain_components(rows)
    assert {r["component_id"] for r in got} == {5}


def test_join_of_an_empty_table(spark):
    assert rows_of(jj.jaccard_classes(table(spark, edge_rows()).limit(0))) == []


# --- language model


def plain_katz(rows):
    """The model by its definition, token by token, and a check that every distribution sums to one."""
    learned = [[*tokens(t), None] for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    uni, pair = Counter(w for d in learned for w in d), Counter(p for d in learned for p in zip(["<s>", *d], d))
    total = sum(uni.values())
    f1, f2 = (lm.discounts(Counter(c.values())) for c in (uni, pair))
    factor = lambda f, n: f[min(n, lm.TRUSTED + 1)]
    kept = sum(factor(f1, n) * n for n in uni.values())
    scale = total + (abs(total - kept) < 1e-9)
    p1 = lambda w: factor(f1, uni[w]) * uni[w] / scale if w in uni else 1 - kept / scale
    after: dict = {}
    for (h, w), n in pair.items():
        after.setdefault(h, {})[w] = n

    def p2(h, w):
        if h not in after:
            return p1(w)
        seen = after[h]
        mass, size = sum(factor(f2, n) * n for n in seen.values()), sum(seen.values())
        size += abs(size - mass) < 1e-9
        if w in seen:
            return factor(f2, seen[w]) * seen[w] / size
        return (1 - mass / size) / (1 - sum(map(p1, seen))) * p1(w)

    if total:
        for h in [*list(after)[:40], "<s>", b"never seen"]:
            assert sum(p2(h, w) for w in [*uni, b"unknown word"]) == pytest.approx(1, abs=1e-9)
    for i, t, *_ in rows:
        d = [*tokens(t), None]
        yield (
            i,
            len(d),
            sum(w in uni for w in d),
            total,
            sum(math.log10((uni.get(w, 0) + 1) / (total + len(uni) + 1)) for w in d),
            sum(math.log10(p2(h, w)) if total else 0.0 for h, w in zip(["<s>", *d], d)),
        )


@pytest.mark.parametrize("block", [300, 4_000_000])
def test_scores_equal_the_definition(spark, block):
    rows = [(i, text(i % 70, 10 + i % 50) + " the the of " * (i % 4)) for i in range(160)] + [r[:2] for r in edge_rows() if r[0] != 5] + [(500, "new0 new1 new2 the of")]
    got = rows_of(lm.score_documents(table(spark, rows), block=block))
    want = list(plain_katz(rows))
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [(i, text(i % 90, 60)) for i in range(400)]
    held = [r for r in rows_of(lm.score_documents(table(spark, rows))) if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_without_texts(spark):
    only_held = [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert {(r["train_tokens"], r["score"]) for r in rows_of(lm.score_documents(table(spark, only_held)))} == {(0, 0.0)}
    assert rows_of(lm.score_documents(table(spark, edge_rows()).limit(0))) == []


# --- co-training


def judged(spark, n=500):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        t = text(i, 60) if good else " ".join(w + "%%%" for w in words(i, 60))
        rows.append((i, t, "en" if i % 3 else "de", f"s{i % 5 + (0 if good else 3)}"))
        if i % 2:
            labels.append((i, int(good), 0, 1.0))
    labels += [(i, int(i % 4 != 0), 0, 1.0) for i in range(0, n, 4)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score double")


def test_co_training_on_held_out_documents(spark):
    rows, labels = judged(spark)
    got = rows_of(quality_scores(table(spark, rows), labels))
    held = [r for r in got if r["held_out"]]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) == r["held_out"] for r in got)
    assert sum(r["kept"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.98 * len(held)
    assert all(0 <= r[c] <= 1 for r in got for c in ("score", "text_score", "metadata_score"))


def test_the_pool_has_no_labelled_documents(spark, monkeypatch):
    rows, labels = judged(spark, 200)
    sizes = []
    monkeypatch.setattr(ct, "co_train", lambda x, m, y, pool_x, pool_m: sizes.append((len(x), len(pool_x))))
    ct.fit(table(spark, [*rows, (None, "no id")]), labels)
    assert sizes == [(150, 51)]


def test_surest_rows_keep_the_proportion_of_the_classes():
    scores, free = np.array([0.99, 0.95, 0.5, 0.01, 0.02, 0.92]), np.array([True, True, True, True, True, False])
    rows, labels = surest(scores, free, good=0.5, most=4)
    assert sorted(zip(rows.tolist(), labels.tolist(), strict=True)) == [(0, 1.0), (1, 1.0), (3, 0.0), (4, 0.0)]


def test_co_training_edges(spark):
    rows, labels = judged(spark, 120)
    got = rows_of(quality_scores(table(spark, edge_rows()), labels))
    assert len(got) == len(edge_rows())
    assert {r["score"] for r in rows_of(quality_scores(table(spark, rows[:5]), labels.limit(0)))} == {0.5}
    assert rows_of(quality_scores(table(spark, rows).limit(0), labels)) == []
