import numpy as np
import pytest
from pyspark.sql import functions as F

from pedalflow.llm import langid

EN = "the house and the river with other things that were there before us"
DE = "das Haus und der Fluss mit anderen Dingen die vorher schon dort waren"


def test_normalise_and_codes_against_plain_python():
    texts = ["Héllo, ÄÖ 12!", "", "a", "  x--y  ", "ABCD", "漢字"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    data, o = langid.normalise(raw, offs)
    got = [bytes(data[a:b]).decode() for a, b in zip(o[:-1], o[1:], strict=True)]
    assert got == [" héllo äö ", " ", " a ", " x y ", " abcd ", " 漢字 "]
    found, begins = langid.codes(data, o)
    for k, t in enumerate(got):
        b = t.encode()
        n = langid.GRAM
        want = [b[i : i + n] for i in range(len(b) - n + 1)] or [b.ljust(n)]
        assert [int(x).to_bytes(n, "little") for x in found[begins[k] : begins[k + 1]]] == want


def test_predicts_held_out_texts_and_defines_odd_ones(spark):
    rows = [(t[i:], lang) for t, lang in ((EN, "en"), (DE, "de")) for i in range(0, 40, 4)] + [(None, "en"), ("x", None)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["de", "en"]
    df = spark.createDataFrame([(1, "the other river", "q"), (2, "und der andere Fluss", "q"), (3, None, "q"), (4, "12 !?", None), (5, "", ""), (6, "qqq", ""), (1, "the other river", "q")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[1][1] > 0.3
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "de"
    assert langid.predict(df, model).count() == 7


def test_more_than_64_languages(spark):
    # Each language has letters of its own beside one that all share.
    rows = [(" ".join(chr(0x4E00 + 40 * i + j) * 2 + "a" * 4 for j in range(8)), f"l{i:02d}") for i in range(70)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    df = spark.createDataFrame(rows, "text string, lang string")
    assert langid.predict(df, model).where("lang = lang_pred").count() == 70


def test_nothing_learned_and_no_rows(spark):
    model = langid.learn(spark.createDataFrame([], "text string, lang string"))
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.predict(df, model).collect()] == [("und", 0.0)]
    assert langid.predict(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    out = langid.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()


@pytest.mark.parametrize("many", [1, 3])
def test_false_positive_correction_keeps_shares_in_bounds(spark, many):
    model = langid.learn(spark.createDataFrame([(EN * many, "en"), (DE * many, "de")], "text string, lang string"))
    raw = np.frombuffer((EN + DE).encode(), np.uint8)
    best, share = model.score(raw, np.array([0, len(EN), len(raw)]))
    assert best.tolist() == [1, 0] and ((share >= 0) & (share <= 1)).all()


def grams(text):
    """A text's n-grams in plain Python."""
    import re

    b = (" " + re.sub("[^a-z\x80-\U0010ffff]+", " ", (text or "").lower()).strip() + " ").replace("  ", " ").encode()
    return [b[i : i + langid.GRAM] for i in range(len(b) - langid.GRAM + 1)] or [b.ljust(langid.GRAM)]


def test_predictions_equal_exact_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs.where("doc_id % 2 = 0"))
    sets = {}
    for r in docs.where("doc_id % 2 = 0").collect():
        sets.setdefault(r.lang, set()).update(grams(r.text))
    rows = docs.where("doc_id % 2 = 1").collect()
    found = {r.doc_id: r for r in langid.predict(docs.where("doc_id % 2 = 1"), model).collect()}
    for r in rows:
        g = grams(r.text)
        share = {k: sum(x in s for x in g) / len(g) for k, s in sets.items()}
        got = found[r.doc_id]
        if got.lang_pred == langid.UNKNOWN:
            continue
        # A Bloom filter may err by its rate of false positives, which the score takes out on average.
        room = 0.02 + 2 / len(g)
        assert abs(got.score - share[got.lang_pred]) < room and share[got.lang_pred] > max(share.values()) - room


def test_every_ngram_is_in_its_filter(spark):
    rows = [("aaaa bbbb cccc", "x")] + [("bbbb cccc dddd " * 50, "y")] * 40
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    raw = np.frombuffer(rows[0][0].encode(), np.uint8)
    best, share = model.score(raw, np.array([0, len(raw)]))
    assert model.langs[best[0]] == "x" and share[0] > 0.999


def test_the_sample_is_bounded_and_whole_texts_are_judged(spark):
    rows = [(i, f"{EN} {i}", "en") for i in range(60)] + [(100 + i, f"{DE} {i}", "de") for i in range(60)] + [(None, EN, "en"), (700, None, None), (500, "!! " * 500_000 + DE * 3, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("Score", F.lit("s")).withColumn("LANG_pred", F.lit(1))
    model = langid.learn_from_documents(df, 5)
    assert model.langs == ["de", "en"]
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {(r.doc_id, r.lang_pred) for r in got.where("doc_id in (500, 700) or doc_id is null").collect()} == {(500, "de"), (700, "und"), (None, "en")}
    again = langid.learn_from_documents(df.repartition(3), 5)
    assert (again.table == model.table).all()


def test_filter_sizes():
    assert langid.filter_size(0) == langid.filter_size(1) == langid.LEAST_SLOTS and langid.filter_size(10**9) == langid.MOST_SLOTS
    assert langid.filter_size(langid.LEAST_SLOTS) == langid.ROOM * langid.LEAST_SLOTS
