import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from pedalflow.llm import gru, lm
from pedalflow.llm.gru import HIDDEN, Gru

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows):
    """Base scores word by word."""
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]) for d, t in rows]
    fold = lambda d: 0 if d is None else crc32(str(d).encode()) % 10
    c = Counter(w for d, t in tokens if fold(d) for w in t)
    n, v = sum(c.values()), len(c)
    return sorted((str(d), fold(d) == 0, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for d, t in tokens)


def ours(df):
    out = lm.score(df).collect()
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)


def test_base_scores_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 200)
    monkeypatch.setattr(lm, "HOLD_BYTES", 900)
    rows = [(i, f"The cat{i % 7} sat on É the mat {i}\t\nEND") for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \t"), (None, "a b"), (5, rows[5][1]), (73, "w " * 3000), (74, "x\xa0y ÀÉ")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    assert ours(df) == plain(rows)


def test_nothing_to_learn_from_and_no_rows(spark):
    held = [i for i in range(100) if crc32(str(i).encode()) % 10 == 0]
    rows = [(i, "a b") for i in held]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df) == plain(rows)
    assert lm.score(df.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    net = Gru.fresh(np.arange(1.0, 101.0))
    h = np.random.default_rng(0).standard_normal((1, HIDDEN)).astype(np.float32)
    total = np.exp([net.log_probs(h, np.array([t]))[0] for t in range(100)]).sum()
    assert abs(total - 1) < 1e-3


def test_state_is_carried_over_windows_and_batches_do_not_matter():
    rng = np.random.default_rng(2)
    net = Gru.fresh(np.ones(120))
    docs = [np.append(rng.integers(1, 120, n), 0) for n in (0, 1, 31, 32, 33, 150)]
    begins = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    together = net.score(np.concatenate(docs), begins)
    for d, got in zip(docs, together, strict=True):
        h, last, want = np.zeros((1, HIDDEN), np.float32), np.zeros(1, np.int64), 0.0
        for t in d:
            h, _ = net.step(last, h)
            want += net.log_probs(h, np.array([t]))[0]
            last = np.array([t])
        assert got == pytest.approx(want, rel=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = Gru.fresh(np.array([5, 9, 3, 2.0] * 30))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    given, goal = rng.integers(0, 120, (6, 4)), rng.integers(0, 120, (6, 4))
    goal[4:, 1] = -1
    h = rng.standard_normal((4, HIDDEN))
    grads = net.gradients(given, goal, h)[0]
    rows, values = grads["embed"]
    grads["embed"] = np.zeros_like(net.w["embed"])
    grads["embed"][rows] = values
    for k in net.NAMES:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old, near = net.w[k][at], []
        for step in (1e-5, -1e-5):
            net.w[k][at] = old + step
            near.append(net.gradients(given, goal, h)[2])
        net.w[k][at] = old
        assert (near[0] - near[1]) / 2e-5 == pytest.approx(grads[k][at], rel=1e-4)


def test_trains_on_every_window_of_a_document():
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(1, 120, n), 0) for n in (0, 1, 31, 32, 33, 150, 3000, *rng.integers(0, 200, 100).tolist())]
    docs.append(np.append(np.arange(2, 100), 0))
    begins = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    net = Gru.fresh(np.ones(120))
    windows = []
    whole = net.gradients

    def seen(given, target, h):
        out = whole(given, target, h)
        windows.extend((given[:, j], target[:, j], h[j], out[1][j]) for j in range(given.shape[1]))
        return out

    net.gradients = seen
    assert net.train(np.concatenate(docs), begins, 7) == begins[-1]
    assert Counter(t for _, target, _, _ in windows for t in target.tolist() if t >= 0) == Counter(np.concatenate(docs).tolist())
    # The long document's windows come in order, each from the state that the one before left.
    long, last, at = docs[6], np.zeros(HIDDEN, np.float32), 0
    for given, target, h, after in windows:
        part = long[at : at + len(target)]
        if len(part) and (target[: len(part)] == part).all() and (h == last).all():
            assert given[0] == (long[at - 1] if at else 0) and (given[1 : len(part)] == part[:-1]).all()
            last, at = after, at + len(part)
    assert at == len(long)


def test_learns_where_all_documents_are_long(spark):
    rng = np.random.default_rng(6)
    # Each word is followed by the next one of eight, which no unigram can tell.
    rows = [(i, " ".join(f"word{(k + s) % 8}" for k in range(4000))) for i, s in enumerate(rng.integers(0, 8, 24).tolist())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = lm.score(df).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert out.s > 0.5 * out.b


def test_beats_the_base_on_held_out_documents(spark):
    out = lm.op6_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert out.s > out.b


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(spark.createDataFrame([(None, "a b"), (3, "an other text of this id"), (3, None)], docs.schema))
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 4)) for r in lm.score(df).collect())
    assert key(docs.repartition(1)) == key(docs.repartition(5, "text"))


def test_a_score_does_not_depend_on_what_is_scored_beside_it():
    """To the last bit; documents of one word stand alone at times."""
    rng = np.random.default_rng(4)
    net = Gru.fresh(rng.integers(1, 50, 200).astype(float))
    docs = [np.append(rng.integers(1, 200, n), 0) for n in (0, 1, 31, 33, 600, *rng.integers(0, 90, 120).tolist())]
    score = lambda some: net.score(np.concatenate(some), np.concatenate(([0], np.cumsum([len(d) for d in some]))))
    together = score(docs).tolist()
    for n in (1, 2, 3, 17, 50):
        assert [x for i in range(0, len(docs), n) for x in score(docs[i : i + n]).tolist()] == together


def test_counts_of_shared_and_own_words():
    hashes = np.array([9, 4, 9, 7, 9, 4], np.uint64)
    learn = np.array([True, True, False, False, True, False])
    shared = np.array([4], np.uint64), np.array([50])
    assert lm._counts(hashes, learn, *(x.tobytes() for x in shared)).tolist() == [2, 50, 2, 0, 2, 50]
    assert lm._counts(hashes, learn, None, None).tolist() == [2, 1, 2, 0, 2, 1]


def test_rare_words_share_what_the_network_gives_them():
    """The score of a document, word by word, with words outside the vocabulary by their share of the rare ones."""
    net = Gru.fresh(np.array([3.0, 5.0, 4.0, 2.0]))
    model = lm.Model(net, np.array([11, 12], np.uint64), np.array([2, 3]), 14, 7, 3, 5, 4)
    hashes, counts = np.array([11, 77, 12, 78], np.uint64), np.array([4, 3, 2, 0])
    tokens, begins = model.encode(hashes, np.array([0, 4]))
    assert tokens.tolist() == [2, 1, 3, 1, 0]
    h, last, want = np.zeros((1, HIDDEN), np.float32), np.zeros(1, np.int64), 0.0
    for t in tokens.tolist():
        h, _ = net.step(last, h)
        want += float(net.log_probs(h, np.array([t]))[0])
        last = np.array([t])
    want += sum(math.log((c + 0.1) / (5 + 0.1 * 5)) for c in (3, 0))
    got = net.score(tokens, begins)[0] + model.rare(counts[[1, 3]]).sum()
    assert got == pytest.approx(want, rel=1e-5)


def test_a_very_long_text_and_clashing_columns(spark):
    rows = [(1, "The " + "long way " * 150_000), (2, "the way"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS SCORE", "2 AS Chunk")
    for got, want in zip(ours(df), plain(rows), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], rel=1e-9)


def test_segments_of_a_long_document_cover_it_once():
    rng = np.random.default_rng(9)
    docs = [np.append(rng.integers(1, 60, n), 0) for n in (gru.SEGMENT * 3 + 5, 7, gru.SEGMENT - 1)]
    begins = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    net, seen = Gru.fresh(np.ones(60)), []
    whole = net.gradients
    net.gradients = lambda given, target, h: seen.extend(zip(given.T.ravel().tolist(), target.T.ravel().tolist(), strict=True)) or whole(given, target, h)
    assert net.train(np.concatenate(docs), begins, 7) == begins[-1]
    want = Counter((int(a), int(b)) for d in docs for a, b in zip(np.append(0, d[:-1]), d, strict=True))
    assert Counter(x for x in seen if x[1] >= 0) == want


def test_scores_equal_a_plain_network_word_by_word():
    """One document after the other, one token after the other, probabilities of all classes and all their tokens."""
    import numpy as np

    from pedalflow.llm import gru

    rng = np.random.default_rng(5)
    net = gru.Gru.fresh(rng.integers(1, 50, 150).astype(float))
    for k, v in net.w.items():
        if k != "word_b":
            v += rng.standard_normal(v.shape).astype(np.float32) * 0.3
    lengths = [1, 2, 40, 130, 7]
    tokens = np.concatenate([np.append(rng.integers(1, 150, n - 1), 0) for n in lengths])
    begins = np.concatenate(([0], np.cumsum(lengths)))
    w, n = {k: v.astype(np.float64) for k, v in net.w.items()}, gru.HIDDEN
    share = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    logistic = lambda x: 1 / (1 + np.exp(-x))
    want = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        h, last, total = np.zeros(n), 0, 0.0
        for token in tokens[a:b]:
            x, g = w["embed"][last], h @ w["u"] + w["b"]
            reset, keep = logistic(x[:n] + g[:n]), logistic(x[n : 2 * n] + g[n : 2 * n])
            h = (1 - keep) * np.tanh(x[2 * n :] + reset * g[2 * n :]) + keep * h
            classes = share(h @ w["klass"] + w["klass_b"])
            whole = np.concatenate([p * share(h @ w["word"][c] + w["word_b"][c]) for c, p in enumerate(classes)])
            assert abs(whole.sum() - 1) < 1e-9
            total += np.log(whole[token])
            last = token
        want.append(total)
    assert np.allclose(net.score(tokens, begins), want, rtol=1e-4)


def test_texts_are_split_into_words_once(spark):
    """Chunks hold words' places among their distinct ones instead of texts."""
    rows = [(i, f"The cat{i % 7} sat on the mat {i}") for i in range(40)] + [(50, None)]
    chunks = lm.chunked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not [f for f in chunks.schema if "string" in f.dataType.simpleString()]
    words = Counter()
    for batch in chunks.toArrow().to_batches():
        for chunk in (lm.Chunk.of(batch, r) for r in range(batch.num_rows)):
            n = np.bincount(chunk.places, np.repeat(chunk.learn, np.diff(chunk.offsets)), len(chunk.hashes))
            assert n.tolist() == chunk.counts.tolist()
            words.update(dict(zip(chunk.ids.to_pylist(), np.diff(chunk.offsets).tolist(), strict=True)))
    assert words == Counter({d: len((t or "").split()) for d, t in rows})


@pytest.mark.parametrize("most", [0, 9, (1 << 16) - 1, 1 << 16, (1 << 24) - 1, 1 << 24, (1 << 32) - 1])
def test_numbers_in_few_bytes(most):
    for numbers in (np.array([most, 0, most // 3]), np.zeros(0, np.int64)):
        assert lm._wide(lm._narrow(numbers), len(numbers)).tolist() == numbers.tolist()


def test_logits_out_of_range_are_shifted_and_leave_others_alone():
    rng = np.random.default_rng(1)
    near, target = rng.standard_normal((46, 6)).astype(np.float32), rng.integers(0, 46, 6)
    logits = near.copy()
    logits[:, 1] += 300
    logits[:, 4] -= 300
    want = logits.astype(np.float64)
    want = want[target, np.arange(6)] - np.log(np.exp(want - want.max(axis=0)).sum(axis=0)) - want.max(axis=0)
    got = gru.log_shares(logits, target)
    assert np.allclose(got, want, atol=1e-4)
    assert got[[0, 2, 3, 5]].tolist() == gru.log_shares(near, target)[[0, 2, 3, 5]].tolist()
    loss, by = gru.softmax_loss(logits, target)
    assert loss == pytest.approx(-want.sum(), rel=1e-5) and np.abs(by.sum(axis=0)).max() < 1e-5
