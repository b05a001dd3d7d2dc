"""Merkle manifest, exact copies, whitening: plain versions, edges, plans."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tankline.llm import exact_dedup, merkle, sha_states
from tankline.llm.exact_dedup import exact_duplicates, index_texts
from tankline.llm.merkle import verify_tampered
from tankline.llm.whitening import decompose, jacobi, pivoted_cholesky, whiten
from tests.llm.data import edge_rows, rows_of, table, text


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- Merkle manifest -------------------------------------------------------------------------


def plain_leaf(r, n_chars):
    fields = (r["doc_id"], r["source"], r["lang"], n_chars, r["text"])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + arity])) for i in range(0, len(x), arity)])
    return levels


def plain_proof(levels, i, arity):
    steps = []
    for x in levels[:-1]:
        first = i - i % arity
        steps.append((i - first, x[first : first + arity]))
        i //= arity
    return steps


def plain_manifest(rows, modulus=7, arity=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in names:
        ordered = sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["n_chars"])))
        trees[k] = ordered, plain_tree([plain_leaf(r, r["n_chars"]) for r in ordered], arity)
    forest = plain_tree([trees[k][1][-1][0] for k in names], arity)
    out = []
    for j, k in enumerate(names):
        ordered, levels = trees[k]
        for i, r in enumerate(ordered):
            steps = plain_proof(levels, i, arity) + plain_proof(forest, j, arity)
            n = r["n_chars"]
            if r["doc_id"] is not None and n is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == 0:
                n += 1
            cur = plain_leaf(r, n)
            for s, run in steps:
                cur = sha("".join(cur if p == s else x for p, x in enumerate(run)))
            proof = "".join(x for s, run in steps for p, x in enumerate(run) if p != s)
            root = forest[-1][0]
            out.append((r["doc_id"], levels[0][i], levels[-1][0], root, sha(proof), cur, cur == root))
    return out


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def many_rows():
    rows = [*edge_rows(), (2**62, "", "", "z"), (20, "a", None, None), (21, "b", None, "ü")]
    rows += [(1000 + i, f"text {i}", "en", "a") for i in range(300)] + [(5000 + i, f"texte {i}", "fr", "b") for i in range(65)]
    return rows + [(i, f"{i}", f"lang {i}", None) for i in range(6000, 6070)]


@pytest.mark.parametrize("arity", [2, 3, 70])
def test_manifest_equals_a_plain_tree(spark, arity):
    docs = table(spark, many_rows())
    got = [tuple(r) for r in verify_tampered(docs, 7, arity).collect()]
    same(got, plain_manifest(rows_of(docs), 7, arity))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 129])
def test_manifest_of_one_group(spark, n):
    docs = table(spark, [(i, f"t {i}", "en", None) for i in range(n)])
    same([tuple(r) for r in verify_tampered(docs, 3).collect()], plain_manifest(rows_of(docs), 3))


def test_largest_counts_can_be_tampered_with(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, "x", "en", "s", n) for i in range(4) for n in (2**63 - 1, None)], schema)
    same([tuple(r) for r in verify_tampered(docs, 1).collect()], plain_manifest(rows_of(docs), 1))


def test_states_equal_the_standard_hash():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    columns = sha_states.unpack(b"".join(digests))
    above, before = sha_states.parents(columns, np.arange(11), 4)
    want = [sha("".join(d.hex() for d in digests[i : i + 4])) for i in range(0, 11, 4)]
    assert [x.hex() for x in np.split(np.frombuffer(sha_states.pack(above), "u1"), 3) for x in [x.tobytes()]] == want
    # From the state before slot 1 of the second parent, with another digest there, and what stands to its right.
    other = sha_states.unpack(hashlib.sha256(b"other").digest())
    state = sha_states.feed(before[:, 5:6], other)
    for right in (6, 7):
        state = sha_states.feed(state, columns[:, right : right + 1])
    replaced = [digests[4], hashlib.sha256(b"other").digest(), *digests[6:8]]
    assert sha_states.pack(sha_states.finish(state, np.array([4]))).hex() == sha("".join(d.hex() for d in replaced))


def test_folding_reads_no_left_sibling():
    """A fold is given the state, the replacement and what stands to the right, nothing else."""
    digests = sha_states.unpack(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(64)))
    sizes, heights = np.array([64]), np.array([6])
    levels, roots = merkle.climb(digests, sizes, heights, 2)
    blind = []
    for nodes, states, counts, starts in levels:
        nodes = nodes.copy()
        nodes[:, ::2] = 0  # all left siblings
        blind.append((nodes, states, counts, starts))
    folded = merkle._fold_in_blocks(digests.copy(), sizes, blind, 2)
    assert (folded == roots).all()


# --- exact copies ----------------------------------------------------------------------------


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        left = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), left, sha(t)))
            left = False
    return out


def copies():
    rows = [*edge_rows(), (30, "a  b\tc", "x", "y"), (29, "a b\nc"), (31, "a b c"), (32, "a bc"), (33, " a b c"), (34, "A b c"), (35, "a\xa0b c"), (36, "a b c")]
    rows += [(None, "only without id"), (None, "only  without id"), (-5, text(6)), (40, "  "), (41, "\t"), (42, None)]
    return rows + [(100 + i, f"copy {i % 7}") for i in range(500)]


@pytest.mark.parametrize("options", [{}, {"capacity": 2}, {"capacity": 2, "bits": 3}, {"capacity": 1, "bits": 0}])
def test_dedup_equals_plain_grouping(spark, options):
    got = [tuple(r) for r in exact_duplicates(table(spark, copies()), **options).collect()]
    same(got, plain_dedup(copies()))


def test_dedup_of_nothing(spark):
    assert exact_duplicates(table(spark, copies()).limit(0)).collect() == []


def test_buckets_hold_no_more_than_their_capacity(spark):
    docs = table(spark, [(i, f"text {i % 700}") for i in range(1000)])
    buckets = index_texts(docs, capacity=10).buckets
    held = rows_of(buckets.groupBy("depth", "bucket").agg({"*": "count"}).withColumnRenamed("count(1)", "n"))
    assert sum(r["n"] for r in held) == 700 and max(r["n"] for r in held) <= 10
    depths = {r["depth"] for r in held}
    assert len(depths) > 1  # only overfull buckets are split
    # The buckets' prefixes cover the hashes once: none is the beginning of another.
    paths = [format(r["bucket"], f"0{r['depth']}b") for r in held]
    assert not any(a != b and b.startswith(a) for a in paths for b in paths)


def test_deep_directories_and_chains(spark):
    """Keys that differ in late bits only need more than one round of doublings; texts of one key form a chain."""
    rows = [(i << 40, 1) for i in range(40)] + [(1 << 63) - 1 - i for i in ()]
    classes = spark.createDataFrame([(h, p) for h, p in rows] + [(7 << 40, 2)], "hash long, place int")
    got = rows_of(exact_dedup.split_buckets(exact_dedup.stored(classes, exact_dedup.shared_folder(spark), "classes"), 1, exact_dedup.shared_folder(spark)))
    assert len(got) == 41 and len({(r["depth"], r["bucket"]) for r in got}) == 40
    assert all(r["bucket"] == r["hash"] >> (64 - r["depth"]) for r in got)


def test_dedup_is_native(spark, monkeypatch):
    plans, keep = [], exact_dedup.stored

    def watched(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *rest)

    monkeypatch.setattr(exact_dedup, "stored", watched)
    df = exact_duplicates(table(spark, copies()))
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 4 and not any(w in p for p in plans for w in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


# --- whitening -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x int, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], VECTORS)


def plain_whitening(rows, most=16):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    u = np.array([[x[j] - sums[j] / n for j in range(d)] for x in fit])
    e, v = np.linalg.eigh(u.T @ u / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    x = np.array([[y[j] - sums[j] / n for j in range(d)] for _, y in kept])
    deviations = [sum((n * y[j] - sums[j]) ** 2 for j in range(d)) for _, y in kept]
    return kept, n, deviations, x @ v / np.sqrt(e), e / np.trace(u.T @ u / n)


def random_vectors(n=200, d=20, seed=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d)) * np.linspace(4, 0.5, d) @ r.normal(size=(d, d))
    return [(i, [float(c) for c in v]) for i, v in enumerate(base)]


def test_whitening_equals_an_eigendecomposition(spark):
    rows = random_vectors()
    rows += [(500 + i, rows[3][1]) for i in range(100)]  # copies count once in the fit
    got = sorted(rows_of(whiten(vectors(spark, rows))), key=lambda r: (r["vec_id"], r["component"]))
    kept, n, deviations, white, explained = plain_whitening(rows)
    assert len(got) == 16 * len(kept) and {r["n"] for r in got} == {n} == {200}
    assert [r["deviation"] for r in got[::16]] == deviations
    values = np.array([r["whitened"] for r in got]).reshape(-1, 16)
    signs = np.sign((values * white).sum(0))
    assert np.abs(values - white * signs).max() < 1e-8
    assert np.allclose([r["explained"] for r in got[:16]], explained, rtol=1e-9)
    assert {r["component"] for r in got} == set(range(1, 17)) and got[0]["identity_error"] < 1e-9


def test_incomplete_vectors_are_dropped(spark):
    rows = random_vectors(40, 3)
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 2.0]), (105, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    got = rows_of(whiten(vectors(spark, rows + bad)))
    assert {r["vec_id"] for r in got} == {*range(40), None} and {r["component"] for r in got} == {1, 2, 3} and len(got) == 41 * 3


def test_whitening_without_spread(spark):
    assert rows_of(whiten(vectors(spark, []))) == []
    assert rows_of(whiten(vectors(spark, [(1, None)]))) == []
    assert rows_of(whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))) == []
    flat = rows_of(whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])))
    assert {r["component"] for r in flat} == {1} and len(flat) == 10 and flat[0]["identity_error"] < 1e-9
    assert abs(flat[0]["explained"] - 1) < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(v)]) for i, v in enumerate([0.0, 2.0**40, 3e38, -3e38])]
    got = {r["vec_id"]: r for r in rows_of(whiten(vectors(spark, rows)))}
    assert len(got) == 4 and got[3]["deviation"] is None and all(np.isfinite(r["whitened"]) for r in got.values())
    near = [(i, [10000.0 + i / 64, 10000.0 - i / 64]) for i in range(5)]
    assert {r["deviation"] for r in rows_of(whiten(vectors(spark, near)))} == {200, 50, 0}


def test_cholesky_and_jacobi():
    r = np.random.default_rng(5)
    for d, rank in ((1, 1), (7, 7), (12, 5), (33, 33)):
        b = r.normal(size=(d, rank))
        a = b @ b.T
        factor, order = pivoted_cholesky(a)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, a[order][:, order], atol=1e-10)
        assert np.allclose(np.triu(factor[:rank], 1), 0) and (np.diff(factor.diagonal()) <= 1e-12).all()
        g = jacobi(factor)
        assert np.allclose(g @ g.T, factor @ factor.T, atol=1e-10)
        products = g.T @ g
        assert np.abs(products - np.diag(products.diagonal())).max() < 1e-10 * products.max()
        values, directions = decompose(a)
        want = np.linalg.eigvalsh(a)[::-1][: min(16, rank)]
        assert np.allclose(values, want, rtol=1e-9) and np.allclose(a @ directions, directions * values, atol=1e-8)
