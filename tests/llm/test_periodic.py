import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pedalflow.llm import periodic

WORDS = r"[^\x20\x09-\x0D]+"


def brute_runs(w):
    """Every maximal stretch of each period, kept if no smaller period fits it."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def brute(doc_id, text):
    w = plant(doc_id, re.findall(WORDS, text or ""))
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def op13(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in periodic.op13_periodic(spark, str(tmp_path)).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(13)
    out = []
    for i in range(300):
        w = []
        for _ in range(rnd.randrange(5)):
            w += [rnd.choice("abcdeÄ") for _ in range(rnd.randrange(12))]
            w += [rnd.choice("ab") for _ in range(rnd.randrange(1, 6))] * rnd.choice((1, 2, 3, 4, 5, 9))
        out.append((i, rnd.choice((" ", "\n", " \t ")).join(w)))
    return out


def test_against_brute_force(spark, tmp_path, rows):
    more = [(1000, None), (1001, ""), (1002, " \n"), (None, "x " * 9), (1003, "x " * 5), (1004, "x " * 6), (1005, "x y " * 4), (1006, "x y " * 3 + "x"), (-7, "a b c " * 4), (5, rows[9][1])]
    every = rows + more + rows[:3]
    assert op13(spark, tmp_path, every) == sorted((brute(*r) for r in every), key=str)


def test_planted_texts_of_many_ids(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(str(rnd.randrange(50)) for _ in range(rnd.randrange(1, 200)))) for i in range(400)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    assert op13(spark, tmp_path, rows) == sorted((brute(*r) for r in rows), key=str)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("x x x x x x y", 1, "r", 2, 3)], "text string, n_words int, row string, RUNS int, kept int")
    out = periodic.periodic_runs(df).collect()
    assert [(r.row.n_words, r.row.row, r.row.RUNS, r.n_words, r.kept, [tuple(x) for x in r.runs]) for r in out] == [(1, "r", 2, 7, "x y", [(0, 6, 1)])]
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    assert [r.kept for r in periodic.periodic_runs(df.select("text")).collect()] == ["x y"]


def test_a_very_long_text(spark):
    rnd = random.Random(1)
    block = [f"w{rnd.randrange(10**6)}" for _ in range(70_000)]
    text = " ".join([f"a{i}" for i in range(300_000)] + block * 5 + ["z"] * 1000 + ["q"])
    (row,) = periodic.periodic_runs(spark.createDataFrame([(text,)], "text string")).collect()
    assert [tuple(r) for r in row.runs] == [(300_000, 350_000, 70_000), (650_000, 1000, 1)]
    assert row.kept == " ".join([f"a{i}" for i in range(300_000)] + block + ["z", "q"])


def test_words_of_runs_survive_the_mask():
    rng = np.random.default_rng(2)
    assert periodic.OVERLAP == 5
    for _ in range(300):
        parts = [rng.integers(0, 4, int(rng.integers(0, 60))) for _ in range(3)]
        codes, offsets = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        left = periodic.survivors(codes, offsets)
        for a, p in zip(offsets, parts, strict=False):
            for s, n, _ in brute_runs(p.tolist()):
                assert left[a + s : a + s + n].all()
        start, end, period = periodic.runs_of(codes, offsets)
        want = [(a + s, a + s + n, q) for a, p in zip(offsets, parts, strict=False) for s, n, q in brute_runs(p.tolist())]
        assert sorted(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == sorted(want)


def test_distinct_words_leave_nothing_for_the_search(monkeypatch):
    monkeypatch.setattr(periodic, "Blocks", None)
    codes = np.arange(10_000)
    assert len(periodic.runs_of(codes, np.array([0, 4000, 10_000]))[0]) == 0
