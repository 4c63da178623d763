import math

import numpy as np

from pedalflow.llm import quality as q


def test_chunks_cover_every_byte():
    lengths = [0, 1, q.CHUNK, q.CHUNK + 1, 5000]
    raw = np.arange(sum(lengths), dtype=np.int64).astype(np.uint8) | 1
    offs = np.concatenate(([0], np.cumsum(lengths)))
    block, begins = q.chunks(raw, offs)
    for d, n in enumerate(lengths):
        text = raw[offs[d] : offs[d + 1]]
        seen = 0
        for k, c in enumerate(block[begins[d] : begins[d + 1]]):
            part = text[k * q.HOP : k * q.HOP + q.CHUNK]
            assert c[: len(part)].tolist() == part.tolist() and not c[len(part) :].any()
            seen = k * q.HOP + len(part)
        assert seen == n


def test_gradients_against_differences():
    net = q.Net({k: v.astype(np.float64) for k, v in q.Net.fresh(3).w.items()})
    rng = np.random.default_rng(0)
    raw = rng.integers(32, 120, 4000).astype(np.uint8)
    offs = np.array([0, 1500, 1500, 4000])
    block, begins = q.chunks(raw, offs)
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        z = net.logits(raw, offs)
        return float((np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)).mean())

    grads = net.step(block, begins, y, w)
    for k in ("out", "out_b", "hidden", "hidden_b", "conv", "conv_b", "embed"):
        at = np.unravel_index(int(np.abs(grads[k]).argmax()), grads[k].shape)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-5
        up = loss()
        net.w[k][at] = old - 1e-5
        down = loss()
        net.w[k][at] = old
        assert np.isclose((up - down) / 2e-5, grads[k][at], rtol=2e-2), k


def test_blocks_do_not_change_a_score():
    net = q.Net.fresh()
    raw = np.random.default_rng(1).integers(0, 255, 30_000).astype(np.uint8)
    offs = np.array([0, 10, 12_000, 12_000, 30_000])
    assert np.allclose(net.logits(raw, offs), net.logits(raw, offs, block_chunks=2), atol=1e-4)


def test_held_out_accuracy(spark):
    out = q.op4_quality(spark, "/root/testdata/sf0.01")
    assert out.count() == 1000 and out.where("score is null or score < 0 or score > 1").count() == 0
    held = out.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert held.where("predicted = quality").count() >= 0.85 * held.count()


def test_odd_rows_and_one_class(spark):
    df = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (2, "", 0.1), (None, "x " * 9000, None)], "doc_id long, text string, score double")
    out = q.score(df, q.Net.fresh()).collect()
    assert len(out) == 4 and all(0 < r.score < 1 for r in out) and len({r.score for r in out if r.doc_id}) == 1
    labels = spark.createDataFrame([(5, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert isinstance(q.learn(df, labels), float)
    assert q.score(df, q.learn(df, labels.limit(0))).where("score = 0.5").count() == 4
    assert q.score(df.limit(0), q.Net.fresh()).count() == 0


def plain_score(net, text):
    """The probability of one text, loop by loop: every chunk, every filter at every place, largest values, layers."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    data = text.encode()
    starts = [0]
    while starts[-1] + q.CHUNK < len(data):
        starts.append(starts[-1] + q.HOP)
    pooled = []
    for s in starts:
        part = data[s : s + q.CHUNK].ljust(q.CHUNK, b"\0")
        steps = [np.concatenate([w["embed"][b] for b in part[i : i + q.STEP]]) for i in range(0, q.CHUNK, q.STEP)]
        values = []
        for f in range(q.FILTERS):
            places = [sum(steps[i + k] @ w["conv"][:, k * q.FILTERS + f] for k in range(q.SPAN)) for i in range(len(steps) - q.SPAN + 1)]
            values.append(max(0.0, max(places) + w["conv_b"][f]))
        pooled.append(values)
    pooled = np.array(pooled)
    features = [*pooled.max(axis=0), *pooled.mean(axis=0)]
    hidden = [max(0.0, features @ w["hidden"][:, h] + w["hidden_b"][h]) for h in range(q.HIDDEN)]
    return 1 / (1 + math.exp(-(hidden @ w["out"] + w["out_b"][0])))


def test_scores_against_a_plain_convolution(spark):
    net = q.Net.fresh(9)
    net.w["conv_b"] += np.float32(0.1)
    texts = ["", "short", "Grün und naß. " * 60, "x" * q.CHUNK, "y" * (q.CHUNK + 1), "many words 12 !? " * 250]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'k' AS Score")
    for r in q.score(df, net).collect():
        assert np.isclose(r.score, plain_score(net, texts[r.doc_id]), rtol=1e-4, atol=1e-6)


def test_long_documents_take_part_in_training(spark):
    rows = [(i, ("good clean prose " if i % 2 else "zq## $$ x9x9 ") * 9000) for i in range(40)] + [(3, "other"), (None, "x"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    net = q.learn(docs, labels)
    assert isinstance(net, q.Net)
    again = q.learn(docs.repartition(3), labels.repartition(2))
    assert all((net.w[k] == again.w[k]).all() for k in net.w)
    found = {r.doc_id: r.score for r in q.score(docs.where("doc_id > 3 and text is not null"), net).collect()}
    assert min(s for d, s in found.items() if d % 2) > max(s for d, s in found.items() if not d % 2)
