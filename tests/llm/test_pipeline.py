import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from pedalflow.llm import bpe
from pedalflow.llm.shared import materialise

from .test_jaccard import brute as classes
from .test_substring import brute as cut

SF = "/root/testdata/sf0.01"


def test_every_stage_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 34", "en", None, 5), (90003, docs.first().text, "en", "src0", 3), (None, "the and of", "en", "src1", 10)], docs.schema)
    docs = docs.unionByName(extra)
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialise(stage(spark, tables[-1], SF), f"test-{name}"))
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    for t in tables[:5]:
        assert sorted(t.columns) == sorted(docs.columns)

    start, spoken, single, clean, mixed, tokens = rows
    lost = {r["doc_id"] for r in start} - {r["doc_id"] for r in spoken}
    assert lost == {90001, 90002}

    groups = classes([(r["doc_id"], r["text"]) for r in spoken])
    want = {c for _, _, c in groups if c is not None}
    assert {r["doc_id"] for r in single if r["doc_id"] is not None} == want
    assert len({r["doc_id"] for r in single}) == len(single)

    plain = {d: (n, gone, digest) for d, n, gone, digest in cut([(r["doc_id"], r["text"]) for r in single])}
    got = {r["doc_id"]: r["text"] for r in clean}
    before = {r["doc_id"]: r["text"] for r in single}
    for d, (n, gone, digest) in plain.items():
        if gone and gone == n:
            assert d not in got
        elif gone:
            assert hashlib.sha256(got[d].encode()).hexdigest() == digest
        else:
            assert got[d] == before[d]

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken = Counter(), Counter()
    for r in clean:
        size[r["source"]] += words(r["text"])
    for r in mixed:
        taken[r["source"]] += words(r["text"])
    total = sum(size.values())
    for s in size:
        assert taken[s] <= 3 * size[s]
    assert abs(sum(taken.values()) - total) <= len(size)
    whole = Counter(r["doc_id"] for r in mixed)
    assert max(whole.values()) <= 3 and set(whole) <= set(got)

    enc = bpe.encoder(public_tokenizers.path(bpe.RANKS))
    ids = [np.asarray(enc.encode_ordinary(r["text"]), "<u4").tobytes() for r in mixed]
    assert Counter((r["doc_id"], hashlib.sha256(x).hexdigest(), len(x) // 4) for r, x in zip(mixed, ids, strict=True)) == Counter((r["doc_id"], r["ids_sha256"], r["n_tokens"]) for r in tokens)


def test_components_that_share_an_id_keep_a_row_each(spark):
    one, other = (" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "blue"))
    rows = [(1, one, "en", "s", 0), (1, other, "en", "s", 0), (2, one, "en", "s", 0), (3, other, "en", "s", 0), (3, other, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, one), (1, other)])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows_and_extra_columns(spark):
    prose = " ".join(f"the river and house number {i} stood here before" for i in range(9000))
    rows = [
        (1, prose, "en", "a", 9), (2, "the river and house stood", "en", None, None), (2, "the river and house stood", "en", None, None),
        (3, None, None, "a", None), (4, "", "en", "b", 0), (None, "a house by the river", "en", "b", 1), (5, "12 !?", None, None, 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = "Score Lang_Pred SIZE taken row kept IDS class component n _key starts Piece k".split()
    docs = docs.selectExpr("*", *[f"'x' AS {n}" for n in names])
    want = {
        "language": {1, 2, None},
        "near-duplicates": {1, 2, 3, 4, 5, None},
        "repeated-passages": {1, 2, 3, 4, 5, None},
        "mixing": {1, 2, 5, None},
        "tokens": {1, 2, 3, 4, 5, None},
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.columns == (list(corpus_pipeline.COLUMNS) if name != "tokens" else ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"])
        found = {r.doc_id for r in got.collect()}
        assert found <= want[name] and (name == "mixing" or found == want[name]), name
