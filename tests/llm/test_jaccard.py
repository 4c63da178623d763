import random
import re

import numpy as np
import pytest

from pedalflow.llm import graph, jaccard

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    found = graph.Union()
    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                found.unite(i, j)
    group = {}
    for i, (d, _) in enumerate(sets):
        group.setdefault(found.root(i), []).append(d)
    smallest = {r: min((d for d in ds if d is not None), default=None) for r, ds in group.items()}
    return sorted(((d, len(s), smallest[found.root(i)]) for i, (d, s) in enumerate(sets)), key=str)


def ours(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    out = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice((6, 20, 60, 150)))]
        chain = list(base)
        for _ in range(rnd.choice((2, 5, 25))):
            copy = list(chain if rnd.random() < 0.3 else base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 4))):
                copy[rnd.randrange(len(copy))] = word()
            chain = copy
            out.append(" ".join(copy + (passage if rnd.random() < 0.3 else [])))
    rnd.shuffle(out)
    rows = [(i * 3, t) for i, t in enumerate(out)]
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "a b"), (9005, "A\tB"), (9006, "a b c"), (9007, "ab"), (None, "a b"), (None, "lonely text"), (30, rows[10][1]), (2, rows[50][1].upper())]
    return rows


@pytest.mark.parametrize("block,few", [(768, 24), (7, 24), (7, 1), (2, 4)])
def test_against_brute_force(spark, rows, monkeypatch, block, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(graph, "ALONE_EDGES", 1 << 18 if few == 24 else 4)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, class long, component_id string")
    assert ours(df) == brute(rows)


@pytest.mark.parametrize("few_pairs", [0, 6, 400])
def test_blocked_product_counts_exactly(monkeypatch, few_pairs):
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    monkeypatch.setattr(jaccard, "FEW_PAIRS", few_pairs)
    monkeypatch.setattr(jaccard, "ADDED", 50)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 120, n).astype(np.uint64)) for n in (5, 60, 90, 1, 80, 100, 70)]
    got = jaccard.overlaps(sets, sets[2:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in map(set, sets[2:])] for a in map(set, sets)]


def test_columns_are_enough_for_any_link():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randrange(1, 200)
        m = rng.randrange(-(-4 * n // 5), n + 1)
        common = -(-4 * n // 5) + 0
        if 100 * common < 80 * (n + m - common) or common > m:
            continue
        ids = rng.sample(range(10**6), n + m - common)
        both, x, y = ids[:common], ids[common:n], ids[n:]
        a, b = sorted(both + x), sorted(both + y)
        shared = set(a[: jaccard.columns_of(n)]) & set(b[: jaccard.columns_of(m)])
        assert len(shared) >= max(jaccard.least_columns(n), jaccard.least_columns(m))


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("alone", [1 << 18, 3])
def test_components_of_chains_and_stars(spark, monkeypatch, alone):
    monkeypatch.setattr(graph, "ALONE_EDGES", alone)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(259, 7), (7, 7), (1000, 999)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    found = graph.Union()
    for a, b in edges:
        found.unite(a, b)
    assert got == {x: found.root(x) for e in edges for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_rows_without_id_and_with_one_id(spark):
    rnd = random.Random(4)
    texts = [" ".join(f"{i}w{rnd.randrange(60)}" for _ in range(40)) for i in range(40)]
    near = [t + " more" for t in texts[:20]]
    rows = [(None, t) for t in texts + near] * 3 + [(5, t) for t in texts[20:] + near] + [(9, texts[0])] * 4
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_very_long_text(spark):
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(250_000)]
    rows = [(3, " ".join(words)), (2, " ".join(words[:-5000])), (1, " ".join(words[:100_000])), (4, "x y"), (None, "")]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS N_shingles", "3 AS Class")) == brute(rows)
