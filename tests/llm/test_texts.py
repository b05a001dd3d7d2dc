"""Fingerprints, packing, language, toxicity, pages: edges, round trips, held-out accuracy."""

import hashlib
import math
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tankline.llm import fingerprints as fp
from tankline.llm import packing as pk
from tankline.llm.html_text import extract_text, visible_text
from tankline.llm.language_id import language_id
from tankline.llm.toxicity import CharacterModel, Restorer, fit, restore, toxicity
from tests.llm.data import SYLLABLES, edge_rows, rows_of, table, text, words

# --- fingerprints


def rolling(data: bytes) -> list[int]:
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(fp.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def plain_spans(data: bytes, s: fp.Sizes) -> list[tuple[int, int]]:
    h, spans, start = rolling(data), [], 0
    while start < len(data):
        end = min(start + s.most, len(data))
        for cut in range(start + s.least, end):
            bits = s.strict_bits if cut < start + s.normal else s.loose_bits
            if h[cut - 1] >> (32 - bits) == 0:
                end = cut
                break
        spans.append((start, end))
        start = end
    return spans


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=5))
def test_chunks_equal_a_byte_by_byte_hash(texts):
    assert fp.chunk_spans(texts) == [plain_spans(t, fp.Sizes()) for t in texts]


def test_long_texts_are_hashed_in_overlapping_pieces(monkeypatch):
    data = text(1, 3000).encode()
    want = fp.chunk_spans([data])
    monkeypatch.setattr(fp, "PIECE", 100)
    assert fp.chunk_spans([data]) == want


def test_insertion_shifts_only_nearby_chunks():
    old = text(1, 4000).encode()
    a, b = fp.fingerprints([old, old[:5000] + b"something new" + old[5000:]])
    assert fp.containment(a, b) > 0.97 and fp.containment(a, fp.fingerprints([text(2, 4000).encode()])[0]) == 0


@pytest.mark.parametrize("runs", ["1", "4", "40"])
def test_edited_texts_use_the_next_document(spark, runs):
    rows = [(i * 3, text(i, 10 + i * 7 % 300)) for i in range(200)] + [(1, None), (2, ""), (4, "x")]
    spark.conf.set("spark.sql.shuffle.partitions", runs)
    got = {r["doc_id"]: r for r in rows_of(fp.compare_with_edits(table(spark, rows).repartition(7)))}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edit = t[: len(t) - half] + n[:half]
        a, b, c = fp.fingerprints([t.encode(), edit.encode(), n.encode()])
        want = (len(t), hashlib.sha256(edit.encode()).hexdigest(), fp.as_text(a), fp.as_text(b), fp.containment(a, b), fp.containment(a, c))
        assert tuple(got[i].values())[1:] == want


def test_fingerprint_edges(spark):
    got = rows_of(fp.compare_with_edits(table(spark, edge_rows())))
    assert len(got) == len(edge_rows())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (6, 7)} == {fp.as_text(fp.fingerprints([text(6).encode()])[0])}
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)} == {""}
    assert rows_of(fp.compare_with_edits(table(spark, edge_rows()).limit(0))) == []
    assert len(rows_of(fp.document_fingerprints(table(spark, edge_rows())))) == len(edge_rows())


# --- packing

TOKENIZER = Tokenizer.from_file(pk.TOKENIZER)


def ids(t: str) -> bytes:
    return np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sté 1\n\t\r\xa0 #*<|>."), max_size=40) | st.text(max_size=40), max_size=4))
def test_encoding_by_words_equals_the_whole_text(texts):
    assert pk.Encoder(pk.TOKENIZER).encode(texts) == [ids(t) for t in texts] if len(texts) < 2 else pk.encoder(pk.TOKENIZER).encode(texts) == [ids(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_is_valid_and_no_worse_than_best_fit(lengths):
    plain, better = pk.best_fit(lengths, 64), pk.pack_lengths(lengths, 64)
    for bins in (plain, better):
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= 64 for b in bins)
    assert -(-sum(lengths) // 64) <= len(better) <= len(plain)


def test_exchanges_empty_a_bin():
    lengths = [6, 6, 5, 5, 4, 4]  # best fit leaves 6+4, 6+4, 5+5
    assert len(pk.improve([[0, 2], [1, 3], [4, 5]], lengths, 15)) == 2
    assert len(pk.improve([[0], [1], [2]], [5, 5, 5], 15)) == 1
    moved = pk.improve([[0, 1, 2], [3, 4], [5]], [4, 4, 3, 6, 2, 5], 12)  # 24 tokens for two bins
    assert sorted(sum([4, 4, 3, 6, 2, 5][i] for i in b) for b in moved) == [12, 12]


def test_texts_that_spell_special_tokens():
    added = [t.content for t in TOKENIZER.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in added
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>\nb", "a <|endoftext| > b", "plain words only"]
    assert pk.Encoder(pk.TOKENIZER).encode(texts) == [ids(t) for t in texts]
    assert zlib.crc32(ids("a <|endoftext|> b") + np.array([2], dtype="<u4").tobytes()) == 3672784330


@pytest.mark.parametrize("lengths", [[3] * 8192, [600] * 4000, [513 + i % 90 for i in range(4000)], [1 + i * i % 700 for i in range(8192)], [341, 342, 340, 5] * 2000], ids=lambda x: str(x[:3]))
def test_large_groups_are_packed_at_once(lengths):
    start = time.perf_counter()
    bins = pk.pack_lengths(lengths)
    assert time.perf_counter() - start < 20
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in bins) <= 1024 and len(bins) <= len(pk.best_fit(lengths, 1024))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=25))
def test_the_search_ends_where_no_exchange_is_left(lengths):
    bins = [[lengths[i] for i in b] for b in pk.pack_lengths(lengths, 20)]
    if len(bins) == -(-sum(lengths) // 20):
        return
    for a, poor in enumerate(bins):
        for b, full in enumerate(bins):
            if a == b or sum(full) < sum(poor):
                continue
            give = [(x,) for x in poor] + list(combinations(poor, 2))
            back = [()] + [(x,) for x in full] + list(combinations(full, 2))
            left = [(g, t) for g in give for t in back if len(g) + len(t) < 4 and (len(g) < 2 or t)]
            assert not any(0 < sum(g) - sum(t) <= 20 - sum(full) for g, t in left)


def test_pieces():
    assert pk.pieces_of(5, 4) == [(0, 1), (1, 4)] and pk.pieces_of(8, 4) == [(0, 4), (4, 4)] and pk.pieces_of(1, 4) == [(0, 1)]


def test_packed_sequences_round_trip(spark):
    rows = [*edge_rows(), *[(100 + i, text(i, 5 + i * 13 % 700)) for i in range(60)]]
    placed = rows_of(pk.pack_documents(table(spark, rows), with_ids=True))
    by_place = {}
    for r in placed:
        assert r["length"] == len(r["ids"]) <= 1024 and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        by_place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t, *_ in rows:
        if i != 7:
            parts = sorted((r["piece"], r["start"], r["ids"]) for r in placed if r["doc_id"] == i)
            own = [x for _, _, p in parts for x in p]
            assert np.array(own, dtype="<u4").tobytes() == ids(t or "") + np.array([2], dtype="<u4").tobytes()
            assert all(len(p) == 1024 for _, _, p in parts[1:])
    assert sum(r["doc_id"] == 7 for r in placed) == 2
    assert sum(len(r["ids"]) for r in rows_of(pk.sequences(table(spark, rows)))) == sum(r["length"] for r in placed)
    assert rows_of(pk.pack_documents(table(spark, rows).limit(0))) == []


# --- language

TONGUES = {"en": SYLLABLES, "de": "sch ein der ung keit ich ach zu ver ge be en er".split(), "fr": "eau oi tion ment eux ai le que re é è".split()}


def spoken(lang: str, seed: int, n: int = 60) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(TONGUES[lang], size=r.integers(1, 4))) for _ in range(n))


def test_language_of_held_out_documents(spark):
    rows = [(i, spoken(x := list(TONGUES)[i % 3], i), x if i % 7 else None, "s") for i in range(400)]
    got = {r["doc_id"]: r for r in rows_of(language_id(table(spark, rows)))}
    assert len(got) == 400
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == list(TONGUES)[i % 3] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark):
    rows = [*edge_rows(), *[(100 + i, spoken("en" if i % 2 else "de", i), "en" if i % 2 else "de", "s") for i in range(40)]]
    got = {r["doc_id"]: r for r in rows_of(language_id(table(spark, rows)))}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 11}
    assert all(r["score"] == 0 for r in got.values() if r["lang_pred"] == "und")
    nothing = rows_of(language_id(table(spark, [(1, "abc def")])))
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert rows_of(language_id(table(spark, rows).limit(0))) == []


# --- toxicity

BAD = ["moron", "idiot", "trash", "scum", "loser"]


def labelled(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        w, toxic = words(i, 50), i % 5 == 0
        if toxic:
            w[10:10] = [BAD[i // 5 % 5], BAD[(i // 5 + 2) % 5]]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic), 0.0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score double")


def test_toxic_documents_are_found_also_in_disguise(spark):
    rows, labels = labelled(spark)
    plain = " ".join(words(7, 40))
    hidden = ["m0r0n 1d1ot", "i d i o t and l-o-s-e-r", "tr@@aaash $cum", "MORON!!! (idiot)"]
    clean = ["th1s 2024 re4d", "a b c d e", "hahahaaa sooo", "100%%% $$$ ###"]
    extra = [(1000 + i, f"{plain} {x}") for i, x in enumerate(hidden)] + [(2000 + i, f"{plain} {x}") for i, x in enumerate(clean)]
    got = {r["doc_id"]: r for r in rows_of(toxicity(table(spark, [*rows, *extra, *edge_rows()[:3]]), labels))}
    held = [i for i in range(600) if got[i]["held_out"]] if 1 in got else []
    assert held and all((zlib.crc32(str(i).encode()) % 4 == 2) == got[i]["held_out"] for i in range(4, 600))
    right = sum(got[i]["predicted"] == int(i % 5 == 0) for i in held if i > 3)
    assert right >= 0.98 * len([i for i in held if i > 3])
    assert [got[1000 + i]["predicted"] for i in range(4)] == [1] * 4
    assert [got[2000 + i]["predicted"] for i in range(4)] == [0] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_lattice_search():
    grams = {}
    for w in BAD * 20 + words(5, 300):
        marked = f"^^{w}$"
        for i in range(len(marked) - 2):
            grams[marked[i : i + 3]] = grams.get(marked[i : i + 3], 0) + 1
    model = CharacterModel(grams)
    assert [restore(x, model) for x in ("m0r0n", "1d10t", "tr@sh", "l.o.s.e.r", "moroooon", "$cum")] == ["moron", "idiot", "trash", "loser", "moron", "scum"]


def test_disguises_may_be_combined():
    grams = {}
    for w in [*BAD, "shit", "ass", "kill"] * 20 + words(5, 300):
        marked = f"^^{w}$"
        for i in range(len(marked) - 2):
            grams[marked[i : i + 3]] = grams.get(marked[i : i + 3], 0) + 1
    restorer = Restorer(CharacterModel(grams))
    hidden = {
        "shit": ["s h ! t", "s.h.!.t", "$ h 1 t", "s  h   i\t t", "s h * t", "(s h ! t)", "s s h h ! t", "s h i t, then"],
        "ass": ["@ s s", "@ $ $", "@$$", "455", "a line\na s s", "\ta.s.s", "* s s", "a - s - s"],
        "kill": ["k . i . l . l", "k i l l! now", "k..1..l..l", "kkiilll"],
        "moron": ["mooron", "m 0 0 r 0 n", "m * r * n"],
        "idiot": ["idiiot", "! d ! 0 t", "1 d | o t", "ends here\ni d i o t"],
        "trash": ["t r @ s h", "t~r~@~s~h", "t r 4 a s h"],
    }
    for word, texts in hidden.items():
        for t in texts:
            assert word in restorer.words(t), (word, t, restorer.words(t))
    assert {"letter", "2024"} <= restorer.words("letter 2024")
    assert not {w for w in restorer.words("| a | b | a few words, x and y - no * list * at all") if w in hidden}


def test_toxicity_edges(spark):
    rows, labels = labelled(spark, 60)
    got = rows_of(toxicity(table(spark, edge_rows()), labels))
    assert len(got) == len(edge_rows())
    assert [r["score"] for r in rows_of(toxicity(table(spark, rows[:3]), labels.limit(0)))] == [0.0] * 3
    assert rows_of(toxicity(table(spark, rows).limit(0), labels)) == []


def test_toxicity_learns_from_all_labels(spark):
    """More labelled documents than the 16,000 that were once drawn: every one counts, also in the calibration."""
    n, id_ = 20_000, F.col("id")
    toxic = (id_ % 10 == 0).cast("int")
    word = F.when(id_ % 10 != 0, "kind").when(id_ % 20 == 0, "m0r0n").otherwise("moron")
    rare = F.when(id_ % 2_000 == 0, " scum").otherwise("")
    docs = spark.range(n).select(id_.alias("doc_id"), F.concat(F.lit("some "), word, rare, F.lit(" words")).alias("text"))
    model, odds = fit(docs, spark.range(n).select(id_.alias("doc_id"), toxic.alias("toxic")), modulus=1, remainder=1)
    weight = lambda bad, good: math.log((bad + 0.5) / (2_000 + 1)) - math.log((good + 0.5) / (18_000 + 1))
    want = {"moron": weight(2_000, 0), "scum": weight(10, 0), "kind": weight(0, 18_000)}
    assert {w: model.weights[w] for w in want} == pytest.approx(want)
    assert model.characters.trigrams["^^m"] == 1_000 and model.characters.trigrams["^^s"] == n + 10
    # At the optimum the scores add up to the toxic documents.
    total = odds.agg(F.count("doc_id"), F.sum(model.score(F.col("odds")))).first()
    assert total[0] == n and total[1] == pytest.approx(2_000, abs=0.01)


# --- pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><h1>Head</h1><p>one<p>two <b>bold</b> text
<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li>y</ol><table><caption>Cap</caption><tr><th>Name<th>Qty
<tr><td>Apple<td>10<tr><td>Pear tree<td>2</table><div style="display: none">no</div><p hidden>no</p><pre>
 a  b
   c</pre><!-- no --><script>var a = "<p>no</p>"</script>tail&amp;more<br>line<hr><blockquote>q</blockquote></body></html>"""


def test_page_layout():
    assert visible_text(PAGE).split("\n") == [
        "Head", "", "one", "", "two bold text", "", "- a", "- b", "", "  - c", "- d", "", "3. x", "4. y", "",
        "Cap", "Name       Qty", "Apple      10", "Pear tree  2", "", " a  b", "   c", "", "tail&more", "line", "", "---", "", "    q",
    ]


def test_a_head_ends_where_the_body_begins():
    page = "<head><title>T</title><style>no</style><body>Intro <a>link</a><br>more text<p>block"
    assert visible_text(page).split("\n") == ["Intro link", "more text", "", "block"]
    assert visible_text("<html><head><meta x><title>T</title><script>no</script><body>only <b>inline</b> text") == "only inline text"
    assert visible_text("<head><title>T</title>bare text <i>and</i> more") == "bare text and more"
    assert visible_text("<title>T</title><a>no head</a><head><body>at all") == "no headat all"
    assert visible_text("<head><template><div>no</div>no</template><title>T</title></head><body>x") == "x"


def test_table_spans():
    page = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td colspan=2>wide one<td>f</table>"
    assert visible_text(page).split("\n") == ["a  b  c", "   d  e", "wide one  f"]


def test_tables_with_misplaced_parts_lose_nothing():
    lines = lambda page: [x for x in visible_text(page).split("\n") if x]
    assert lines("<table><tbody><td>x<td>y</tbody><td>z</table>") == ["x  y", "z"]
    assert lines("<table><tr><form><td>x</td><td>y</td></form></tr></table>end") == ["x  y", "end"]
    assert lines("<table><tbody><form action=a><tr><td>x<tr><td>y</form></table>") == ["x", "y"]
    assert lines("<table><tr>text<a>link</a><div>block</div><td>x</tr>more<tbody><p>para<tr><td>y</table>") == ["textlink", "block", "more", "para", "x", "y"]
    assert lines("<table><colgroup><col><b>bold</b><tr><div><td>x<td>y</table>") == ["bold", "x  y"]
    assert lines("<table><tr style='display:none'><td>no</td><i>shown</i></tr><tr><td>x</table>") == ["shown", "x"]
    assert lines("<table><tr><td>a<template><tr><td>no</td></tr>no</template>b<td>c</table>") == ["ab  c"]
    assert lines("<table><tr><td>a<table><td>b</table>c</table>") == ["a", "b", "c"]


@pytest.mark.parametrize("outer", ["<div>", "<b>", "<li>", "<blockquote>", "<ul><li>", "<table><tr><td>"])
@pytest.mark.parametrize("depth", [10, 200, 3000])
def test_deep_elements_are_still_elements(outer, depth):
    inside = "<script>no</script><template><p>no</template><p hidden>no</p><i>a</i><div style='display:none'><b>no</b></div>"
    inside += "<ol><li>b<li>c</ol><table><tr><td>d<td>e<tr><td>long<td>f</table><pre>g  h</pre>"
    lines = [x.lstrip("- ") for x in visible_text(outer * depth + inside + "</div>" * depth + "end").split("\n")]
    assert [x for x in lines if x] == ["a", "1. b", "2. c", "d     e", "long  f", "g  h", "end"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<pre>", "<!--", "-->", "<script>", "</script>", "<a x='", "x", " ", "&amp;", ">", "\n"]), max_size=40))
def test_broken_pages_never_fail(parts):
    out = visible_text("".join(parts))
    assert out == out.rstrip("\n")


def test_visibility_and_declarations():
    shown = lambda page: visible_text(page).split("\n")
    assert shown('<div style="visibility:hidden">no <b style="visibility: visible">yes</b> no</div>') == ["yes"]
    assert shown('<p style="--x-display: none">a</p><p style="not-visibility:hidden">b</p>') == ["a", "", "b"]
    assert shown('<p style="display:none;display:block">a</p><p style="display:block;display:none">b</p>') == ["a"]
    assert shown('<p style="display:none !important;display:block">a</p>b') == ["b"]
    assert shown('<p STYLE="DISPLAY : None">a</p>b') == ["b"]
    assert shown('<ul><li>a<li style="visibility:hidden">no<ul><li style="visibility:visible">b</ul></ul>') == ["- a", "- b"]
    assert shown('<hr style="visibility:collapse">x') == ["x"]
    assert shown('<input value="typed"><input type=password value=no><input type=checkbox value=no><input type=SUBMIT value=Go>') == ["typed Go"]


def test_list_numbers():
    items = lambda attributes, n=3: [x.split(" ")[0] for x in visible_text(f"<ol {attributes}>" + "<li>x" * n + "</ol>").split("\n")]
    assert items("start=-1") == ["-1.", "0.", "1."] and items("reversed") == ["3.", "2.", "1."] and items("reversed start=7") == ["7.", "6.", "5."]
    assert items("type=a start=26") == ["z.", "aa.", "ab."] and items("type=I start=3") == ["III.", "IV.", "V."] and items("type=A start=0") == ["0.", "A.", "B."]


def test_table_widths_and_spans():
    rows = lambda page: visible_text(page).split("\n")
    assert rows("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>") == ["日本  x", "abc   y"]
    assert rows("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>") == ["a  b", "   c", "d  e"]
    long = "<table>" + "<tr><td rowspan=2000>a<td>b" + "<tr><td>c" * 1500 + "</table>"
    assert set(rows(long)[1:]) == {"   c"}
    assert rows("<table><tr><td colspan=1000>a<td>b</table>") == ["a  b"] or len(rows("<table><tr><td colspan=1000>a<td>b</table>")[0]) < 10


@pytest.mark.parametrize(
    "page",
    ["<ul><li>x" * 20_000, "<table><tr><td>x" * 4_000, "<table><tr>" + "<td>x" * 16_000, "<blockquote>x" * 10_000, "<table><tr>" + "<td colspan=1000>x" * 4_000],
    ids=["lists", "tables", "cells", "quotes", "spans"],
)
def test_deep_and_wide_pages_stay_small(page):
    start = time.perf_counter()
    text = visible_text(page)
    assert text.count("x") == page.count("x") and len(text) < 10 * len(page)
    assert time.perf_counter() - start < 5


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<div>" * 3000 + "deep", "u"), (3, "<p>x", "u"), (None, "<p>y", None)], "page_id long, html string, text string")
    got = sorted((str(r["page_id"]), r["text"]) for r in rows_of(extract_text(pages)))
    assert got == [("1", ""), ("2", ""), ("3", "deep"), ("3", "x"), ("None", "y")]
    assert rows_of(extract_text(pages.limit(0))) == []


def test_every_visible_word_of_real_pages_is_kept():
    import re

    import pyarrow.parquet as pq

    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"])["html"].to_pylist():
        body = re.sub(r"(?s)<(head|script|style)\b.*?</\1>|<!--.*?-->|<!.*?>", " ", html)
        import html as h

        want = h.unescape(re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", body))
        want = re.sub(r"<[^>]*>", " ", body) if want is None else re.sub(r"<[a-zA-Z/][^>]*>", " ", re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", body))
        lines = visible_text(html).split()
        assert [w for w in lines if w not in ("-", "---")] == [w for w in h.unescape(want).split() if w not in ("-", "---")]
