import hashlib

import numpy as np
import public_tokenizers
import pytest

from pedalflow.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
TEXTS = [
    "Hello world, it's we'll 123 x²!",
    "",
    None,
    "   \n\t  spaced   out  \n",
    "a" * 3000,
    "don't won't they're " * 200,
    "éàü ß 漢字かな 🙂🙂 " * 90,
    " " * 700 + "x" + " " * 900 + "'re",
    "word " * 400 + "b" * 900 + " tail's end" * 100,
    "'''''''s'r'e " * 120,
]


def whole(text):
    return np.asarray(bpe.encoder(PATH).encode_ordinary(text or ""), "<u4").tobytes()


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (300, 40), (1 << 15, 1 << 9)])
def test_chunked_encoding_equals_whole_encoding(spark, chunk, overlap):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 0), (None, TEXTS[8], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.encode(df, PATH, keep=["doc_id", "text"], chunk=chunk, overlap=overlap).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in out) == sorted((d is None, d or 0, whole(t)) for d, t, _ in rows)


def test_decoding_gives_the_bytes_back_and_digests_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    encoded = bpe.encode(df, PATH, chunk=200, overlap=30)
    for r in bpe.decode(encoded, PATH).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    for r in bpe.digests(df, PATH, ["doc_id"], chunk=200, overlap=30).collect():
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(whole(TEXTS[r.doc_id])).hexdigest() and r.n_tokens == len(whole(TEXTS[r.doc_id])) // 4


def test_a_very_long_text_and_clashing_columns(spark):
    text = "né pas l'été 12 " * 60_000 + "z" * 70_000 + " end's " * 20_000
    df = spark.createDataFrame([(1, text, b"x", "y"), (2, "a b", None, None)], "doc_id long, text string, IDS binary, Kept string")
    got = {r.doc_id: r for r in bpe.encode(df, bpe.RANKS).select("doc_id", "ids", "Kept").collect()}
    assert bytes(got[1].ids) == whole(text) and bytes(got[2].ids) == whole("a b") and got[1].Kept == "y"
    clash = spark.createDataFrame([(2, "a b", 5)], "doc_id long, text string, N_TOKENS int")
    assert bpe.digests(clash, bpe.RANKS, clash.columns).columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH).columns == ["doc_id", "text", "ids"] and bpe.encode(df, PATH).count() == 0


def test_cut_points_resynchronise_after_a_chunk_that_never_met_its_predecessor():
    heads = [np.array([0]), np.array([10, 12]), np.array([20, 21]), np.array([30, 33])]
    tails = [np.array([12, 13]), np.array([22]), np.array([33]), np.array([])]
    assert bpe.cut_points(heads, tails) == [12, None, 33]
    assert bpe.cut_points(heads, tails, sure=True) == [12, None, None]


def test_a_long_run_in_mid_text_leaves_the_rest_in_pieces(spark):
    text = "some words here " * 40 + "b" * 700 + " and on it goes, " * 200
    rows = [(0, text)]
    parts = [(k, s, text[s : s + 264]) for k, s in enumerate(range(0, len(text), 200))]
    found = [bpe.boundaries(p, s + len(p) == len(text)) + s for _, s, p in parts]
    cuts = bpe.cut_points([x[x < s + 64] for x, (_, s, _) in zip(found, parts)], [x[x >= s + 200] for x, (_, s, _) in zip(found, parts)])
    assert None in cuts and None not in cuts[cuts.index(None) + 5 :]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bytes(bpe.encode(df, bpe.RANKS, chunk=200, overlap=64).first().ids) == whole(text)


def test_chunks_that_are_off_alike_are_noticed(monkeypatch):
    import pandas as pd

    text = "x" * 100 + " " + "y" * 100
    one = {"row": ["r"] * 2, "k": [0, 1], "at": [0, 80], "part": [text[:130], text[80:]], "piece": [0, 0], "first": [0, 0], "look": [True, True]}
    assert not bpe._encode_pieces(pd.DataFrame(one | {"stop": [150, 150]}), PATH)["met"].iloc[0]
    assert bpe._encode_pieces(pd.DataFrame(one | {"stop": [100, 100]}), PATH)["met"].iloc[0]
    # All pieces fail at first: the texts take the sure way and still come out whole.
    frame = pd.DataFrame({"row": ["r"], "piece": [0], "ids": [b""], "met": [False]})
    assert bpe._join_pieces(frame)["ids"].iloc[0] is None
