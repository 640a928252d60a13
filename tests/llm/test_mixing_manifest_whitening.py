"""Mixing, manifest and whitening against plain Python, and what they make of awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from covote.llm import manifest, mixing, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, taken string, tree string, i string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, *"abcdef") for i, t, lang, s, n in rows], DOCS)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


AWKWARD = [
    (1, "A b\tc", "en", "s2", 5), (1, "A b\tc", "en", "s2", 5), (1, "another Text", "en", "s2", None), (2, None, None, None, None),
    (3, "", "", "", 0), (None, "no ID here", "en", None, 1), (None, None, "de", "s1", 2), (7, "x " * 200_000, "en", "s1", 400_000),
    (8, " \n ", "fr", "empty", 3), (9, "Ünï cödé \U0001f600", "en", "S", 9),
]


# mixing


def water_level(sizes, weights, share=1.5, repeats=2):
    """Targets by sharing again and again, as the rule is told."""
    target, budget, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while budget > 1e-9 and open_:
        total, over = sum(weights[s] for s in open_), set()
        for s in open_:
            target[s] += budget * weights[s] / total
        budget = 0.0
        for s in open_:
            if target[s] >= repeats * sizes[s]:
                budget, target[s] = budget + target[s] - repeats * sizes[s], float(repeats * sizes[s])
                over.add(s)
        open_ -= over
    return target


def random_docs(seed, n=400):
    r = random.Random(seed)
    sources = ["hot"] * 6 + ["b", "c", "é", "Z", None]
    return [(k, " ".join("w" * r.randrange(1, 9) for _ in range(r.choice([0, 1, 5, 40, 300]))), "en", r.choice(sources), 0) for k in range(n)]


@pytest.mark.parametrize("rows", [random_docs(1), random_docs(2, 30), AWKWARD], ids=["many", "few", "awkward"])
def test_mixing_meets_the_targets(spark, rows):
    got = mixing.planned(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, *_ in rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += words(t)
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    target = water_level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    # at most one document of a source is taken in part, and the rest by whole epochs
    partial = Counter(r.source for r in got if r.size and r.taken % r.size)
    assert all(n == 1 for n in partial.values())
    for s in sizes:
        assert taken[s] == int(target[s] + 1e-9)
    again = mixing.planned(docs(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mixed_rows_hold_what_was_planned(spark):
    rows = AWKWARD + [(100 + i, f"{t}\n", *rest) for i, t, *rest in random_docs(3, 60)]
    plan = mixing.planned(docs(spark, rows), weights=(1, 5), share=1.7, repeats=3)
    mix = mixing.mixed(docs(spark, rows), weights=(1, 5), share=1.7, repeats=3)
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t)
    got = mix.collect()
    by_id = Counter()
    for r in got:
        assert words(r.text) == r.words > 0 and any((t or "").startswith(r.text) for t in texts[r.doc_id])
        by_id[r.doc_id] += r.words
    want = Counter()
    for r in plan.collect():
        want[r.doc_id] += r.taken
    assert +by_id == +want
    assert set(mix.columns) == {*docs(spark, []).columns, "epoch", "words"}


def test_mixing_by_named_weights(spark):
    rows = [(k, "a b c d", "en", "xyz"[k % 3], 0) for k in range(30)]
    weights = spark.createDataFrame([("x", 1), ("y", 3)], "source string, weight int")
    taken = Counter()
    for r in mixing.planned(docs(spark, rows), weights, share=0.5).collect():
        taken[r.source] += r.taken
    assert taken == {"x": 15, "y": 45, "z": 0}


# manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    values = [None if v is None else str(v) for v in (i, source, lang, n, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def sides(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return out


def brute_manifest(rows, tampered):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:3])
        trees[lang] = tree_levels([x[2] for x in by_lang[lang]])
    top = tree_levels([trees[lang][-1][0] for lang in langs])
    root, out = top[-1][0], []
    for k, lang in enumerate(langs):
        for i, (_, _, own, row) in enumerate(by_lang[lang]):
            path = sides(trees[lang], i) + sides(top, k)
            folded = leaf(row, tampered(row))
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((row[0], own, trees[lang][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def lower_every_third(row):
    text, i = row[1], row[0]
    if text is None or i is None or i % 3:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tampering():
    return {"text": F.when(F.col("doc_id") % 3 == 0, manifest.lower_ascii("text")).otherwise(F.col("text"))}


@pytest.mark.parametrize("n", [1, 8, 9, 700])
def test_manifest_equals_plain_trees(spark, n):
    r = random.Random(n)
    rows = [(k, "Ab Ü" * r.randrange(3), r.choice(["en", "en", "de", "zh", "ü", None]), "s", k) for k in range(n)]
    rows += AWKWARD if n > 8 else []
    got = manifest.verified(docs(spark, rows), tampering(), proofs=True).collect()
    assert Counter(tuple(x)[:7] for x in got) == Counter(brute_manifest(rows, lower_every_third))
    for x in got:  # the proof alone leads from the leaf to the root
        node = x.leaf
        for step in x.proof:
            node = sha(step.left + node + step.right)
        assert node == x.root


def test_manifest_of_many_blocks(spark, monkeypatch):
    """Small blocks, so that every level has missing nodes to fetch."""
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    rows = [(k, f"T{k}", "en" if k % 10 else f"l{k % 70}", "s", k) for k in range(600)]
    got = manifest.verified(docs(spark, rows).repartition(5), tampering()).collect()
    assert Counter(map(tuple, got)) == Counter(brute_manifest(rows, lower_every_third))


def test_manifest_without_changes_verifies(spark):
    assert all(x.verified for x in manifest.verified(docs(spark, AWKWARD)).collect())


def test_rows_as_they_were_are_folded_too():
    leaves = pd.DataFrame({"doc_id": [1, 2], "i": [0, 1], "digest": [sha("a"), sha("b")], "found": [None, None]})
    root = sha(sha("a") + sha("b"))

    def steps(i):
        return [("", sha("b"))] if i == 0 else [("", sha("x"))]  # the second proof is not that of its leaf

    out = manifest._lower(False)(leaves, steps, root, {"root": root, "path": None})
    assert list(out["folded_root"]) == [root, sha(sha("b") + sha("x"))]
    assert list(out["verified"]) == [True, False]


# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], "vec_id long, embedding array<float>, n string, x string")


def clustered(seed, n, d):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) + 3 * r.standard_normal((4, d))[r.integers(0, 4, n)]) / 8


def test_whitening_equals_numpy(spark):
    x = clustered(1, 500, 24).astype(np.float32)
    x = np.r_[x, x[:100], x[:1].repeat(300, 0)]  # repeated vectors count once in the fit
    got = whitening.whitened(vectors(spark, [(k, v.tolist()) for k, v in enumerate(x)])).toPandas()
    whole = np.floor(x.astype(float) * 256)
    fit = np.unique(whole, axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    assert len(got) == 4 * len(x) and (got["n"] == len(fit)).all() and got["identity_error"].max() < 1e-9
    sums = [int(s) for s in fit.sum(0)]
    for k, part in got.groupby("component"):
        want = (whole - fit.mean(0)) @ axes[:, -k] / np.sqrt(values[-k])
        part = part.sort_values("vec_id")
        have = part["whitened"].to_numpy()
        assert np.allclose(have * np.sign(have @ want), want, atol=1e-10)
        assert np.allclose(part["explained"], values[-k] / values.sum(), rtol=1e-12)
        for i, far in zip(part["vec_id"][:20], part["deviation"][:20], strict=True):
            assert far == sum((len(fit) * int(v) - s) ** 2 for v, s in zip(whole[i], sums, strict=True))


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [2.0]), (3, [2.0, 0.0, 0.0]), (4, []), (None, [0.5, -0.5, 1.0]), (5, None),
        (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [-0.0, 1e9, 3.0]), (10, [1e17, 0.0, 0.0]),
    ]
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    assert Counter(got["vec_id"].fillna(-1)) == Counter({1: 2 * 3, 2: 3, 3: 3, 4: 3, -1: 3, 9: 3, 10: 3}) or got["component"].max() < 3
    assert (got["n"] == 6).all() and got["identity_error"].max() < 1e-4
    assert got["deviation"].isna().any()  # beyond a BIGINT
    assert got[got["vec_id"] == 2]["whitened"].tolist() == got[got["vec_id"] == 3]["whitened"].tolist()
    for few in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])]):
        assert whitening.whitened(vectors(spark, few)).collect() == []


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 1, 1, 0], [1.0] * 7, [10.0**-k for k in range(12)], [0, 0], [3], [1, 1 - 1e-13, 1e-13]])
def test_divide_and_conquer(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    a = q @ np.diag(np.array(spectrum, float)) @ q.T
    values, vectors_ = whitening.components((a + a.T) / 2)
    assert np.allclose(values, sorted(spectrum, reverse=True), atol=1e-13 * max(1, max(spectrum)))
    assert np.allclose(vectors_.T @ vectors_, np.eye(d), atol=1e-8)
    assert np.allclose(a @ vectors_, vectors_ * values, atol=1e-13 * max(1, max(spectrum)))


@pytest.mark.parametrize("operator", [mixing.planned, mixing.mixed, manifest.verified], ids=lambda f: f.__name__)
def test_no_rows(spark, operator):
    assert operator(docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["op11_mixing", "op12_manifest"])
def test_query_equals_sql(spark, name):
    from pathlib import Path

    import __spark_entry__ as contract

    duckdb = pytest.importorskip("duckdb")
    data = Path("/root/testdata/sf0.001")
    if not data.is_dir():
        pytest.skip("test tables are not here")
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = contract.queries()[name](spark, str(data)).toPandas()
    expected = tables.execute(contract.oracle_sql()[name]).fetchdf()[list(got.columns)]
    order = ["doc_id", *[c for c in got.columns if c != "doc_id"]]
    got, expected = (df.sort_values(order).reset_index(drop=True) for df in (got, expected))
    assert len(got) == len(expected) > 0
    assert all(got[c].equals(expected[c].astype(got[c].dtype)) for c in got.columns)
