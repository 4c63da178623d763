import numpy as np
import pytest

from pedalflow.llm import exact_topk, lsh

NAN, INF = float("nan"), float("inf")


def brute(rows, score, k, every):
    """Every query against every row."""
    seen = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    out = {}
    for q, a in seen:
        if q % every == 0:
            found = sorted({(-score(a, b), i) for i, b in seen if i != q and len(a) == len(b)})
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def floors(a, b):
    return int(sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b, strict=True)))


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [(i, [float(np.float32(x)) for x in rng.standard_normal(9) * (1 + i % 7)]) for i in range(240)]
    out += [(1000 + i, out[5][1]) for i in range(90)]  # one vector that many rows hold
    out += [(500, None), (501, [1.0, None] + [0.0] * 7), (520, [NAN] * 9), (540, [INF] * 9), (None, out[3][1]), (560, []), (600, [0.0] * 9), (580, [1.0, 2.0]), (581, [2.0, 1.0])]
    return out + out[:4]  # repeated rows


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], "x", 1.0) for r in rows], "vec_id long, embedding array<float>, cid string, score double")


@pytest.mark.parametrize("block,ask", [(16, 8), (2048, 256)])
def test_exact_search_against_brute_force(spark, rows, monkeypatch, block, ask):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "ASK", ask)
    assert found_by(exact_topk.top_k(frame(spark, rows))) == brute(rows, floors, 20, 20)


def test_exact_search_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    ints = np.concatenate((rng.integers(-60, 60, (40, 16)), rng.integers(-4, 4, (400, 16))))
    turn = exact_topk.rotation((ints.T @ ints).astype(float))
    asked = exact_topk.Prepared(ints[:10], turn)
    best = exact_topk.vectors.Best(10, 3)
    ids, offs = np.arange(len(ints)), np.arange(len(ints) + 1)
    for a in range(0, len(ints), 40):
        exact_topk.search_block(asked, exact_topk.Prepared(ints[a : a + 40], turn), ids[a : a + 40], offs[: 41], best)
    for i in range(10):
        want = sorted((-int(ints[i] @ c), j) for j, c in enumerate(ints))[:4]
        scores, got = best.listed(i)
        assert [(-int(s), v) for s, v in zip(scores, got, strict=True)] == want


def test_multiprobe_search_scores_exactly_and_recalls(spark, rows):
    want = brute([r for r in rows if r[1] and any(x for x in r[1])], lambda a, b: float(np.dot(a, b)), 20, 20)
    got = found_by(lsh.nearest(frame(spark, rows)))
    assert set(got) <= set(want) and len(got) >= len(want) - 1
    hits = total = 0
    for q, near in want.items():
        mine = got.get(q, [])
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0])) and len({i for i, _ in mine}) == len(mine)
        hits += len({i for i, _ in near} & {i for i, _ in mine})
        total += len(near)
    assert hits >= 0.9 * total


def test_recall_on_the_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    got = found_by(lsh.op7_lsh(spark, "/root/testdata/sf0.1"))
    hits = 0
    for q, near in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]].tolist()) & {i for i, _ in near})
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("skew", ["one", "lognormal"])
def test_recall_where_norms_differ(spark, skew):
    rng = np.random.default_rng(8)
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()], float)
    if skew == "one":
        x[7] *= 50
    else:
        x *= np.exp(0.5 * rng.standard_normal(len(x)))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found_by(lsh.nearest(df))
    hits = 0
    for q, near in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {i for i, _ in near})
    assert len(got) == len(range(0, len(x), 20)) and all(len(near) == 20 for near in got.values())
    assert hits >= 0.9 * 20 * len(got), hits / 20 / len(got)


def test_ties_at_the_cut_go_to_smaller_ids():
    rng = np.random.default_rng(3)
    block = np.array([[bin(i)[2:].zfill(12)[j] == "1" for j in range(12)] for i in range(4096) if bin(i).count("1") == 6][:600], float)  # all tie
    ids = rng.permutation(600)
    pool = lsh.Pool(np.ones((1, 12)), 5)
    for s in range(0, 600, 100):
        pool.offer(np.array([0]), block, np.arange(s, s + 100), ids, np.arange(601))
        pool.settle()
    want = sorted((-float(v.sum()), int(i)) for v, i in zip(block, ids, strict=True))[:6]
    assert pool.listed()[0] == [(-s, i) for s, i in want]


def test_a_query_visits_no_more_buckets_of_a_larger_table():
    """On isotropic vectors, where no number of probes spares a query most of the table."""
    x = np.random.default_rng(0).standard_normal((lsh.PILOT_ROWS, 64))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    small, large = (lsh.fit([(v, 1.0) for v in x], n, 20)[1] for n in (10_000, 50_000))
    assert large <= 1.2 * small, (small, large)


def test_hot_bucket_is_dealt_over_parts(spark, rows, monkeypatch):
    df = frame(spark, rows)
    whole = found_by(lsh.nearest(df))
    monkeypatch.setattr(lsh, "PART_ROWS", 10)
    assert found_by(lsh.nearest(df)) == whole


def test_probe_order_and_closest_wall():
    sets = lsh.template(8)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == lsh.PROBES
    x = np.random.default_rng(0).standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for m in (1, 4, 8):
        own = lsh.bucket_ids(lsh.cells(x, np.zeros(50), m)[0], 12)
        assert (lsh.probe_ids(x, m)[:, :, 0] == own).all() and len(set(lsh.template(m))) == min(3**m, lsh.PROBES)


def test_empty_tables(spark):
    df = frame(spark, [])
    assert exact_topk.top_k(df).count() == 0 and lsh.nearest(df).count() == 0
    df = frame(spark, [(20, [1.0])])
    assert exact_topk.top_k(df).count() == 0 and lsh.nearest(df).count() == 0


def test_ties_go_to_the_smallest_ids(spark):
    """200 different vectors that all score 1 against the query."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(i), -float(i)]) for i in range(1, 201)]
    got = found_by(lsh.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert got[0] == [(i, 1.0) for i in range(1, 21)]


def test_the_pilot_reaches_its_recall_and_meets_less_of_larger_tables():
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.sqrt((x**2).sum(axis=1))[:, None]
    centres = unit(rng.standard_normal((60, 32)))
    near = unit(centres[rng.integers(0, 60, 2000)] + 0.03 * rng.standard_normal((2000, 32)))
    far = unit(rng.standard_normal((2000, 32)))
    shares = {}
    for name, x, n in (("near", near, 2000), ("far", far, 2000), ("large", far, 200_000)):
        m, probes = lsh.fit([(v, 1.0) for v in x], n, 20)
        first = lsh.found_at(x, np.ones(2000), x[:100], m)
        shares[name] = (first <= probes).mean()
        scores = x[:100] @ x.T
        scores[np.arange(100), np.arange(100)] = -np.inf
        want = np.argsort(-scores, axis=1)[:, : max(1, 20 * 2000 // n)]
        assert (np.take_along_axis(first, want, 1) <= probes).mean() >= 0.9 and 2 * m + 1 <= probes <= lsh.PROBES
    assert shares["near"] < 0.6 * shares["far"] and shares["large"] < 0.7 * shares["far"], shares
    assert lsh.fit([(near[0], 1.0)], 2000, 20)[1] == lsh.PROBES


@pytest.mark.parametrize("m", [2, 8])
def test_found_at_against_the_buckets_themselves(m):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 8))
    x /= np.sqrt((x**2).sum(axis=1)).max()
    asked = x[:5] / np.sqrt((x[:5] ** 2).sum(axis=1))[:, None]
    first = lsh.found_at(x, np.ones(80), asked, m)
    whole, _ = lsh.cells(x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1))), m)
    held, visits = lsh.bucket_ids(whole, 8), lsh.probe_ids(asked, m)
    for q in range(5):
        for r in range(80):
            at = [p + 1 for t in range(lsh.TABLES) for p in np.flatnonzero(visits[q, t] == held[r, t]).tolist()]
            assert first[q, r] == min(at, default=lsh.PROBES + 1)


def test_small_tables_are_answered_through_buckets(spark, monkeypatch):
    """Every candidate of a query shares a bucket with it, and some never do; nothing is scanned whole."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 24))
    x = centres[rng.integers(0, 20, 800)] + 0.1 * rng.standard_normal((800, 24))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    m, probes = lsh.fit([(v, 1.0) for v in x], 800, 20)
    first = lsh.found_at(x, np.ones(800), x[::20], m)
    assert 0.01 < (first <= probes).mean() < 0.6
    df = spark.createDataFrame([(i, v.tolist(), 1, "c", 0.5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, d int, cid string, SPAN double")
    got = found_by(lsh.nearest(df))
    hits = 0
    for q, near in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {i for i, _ in near})
    assert hits >= 0.9 * 20 * 40 and len(got) == 40
