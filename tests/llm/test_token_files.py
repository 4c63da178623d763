import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pedalflow.llm import token_files as tf
from pedalflow.llm.shared import new_path

PATH = public_tokenizers.path(tf.TOKENIZER)
TEXTS = ["Hello World's <|endoftext|> 12 x²", "", None, "a b\u0085c\x1cd　e İSTANBUL ΣΑΣ", "é ́x  \t tail", "don't we'll !!! #hash", "long " * 900, "don't we'll !!! #hash", "\ue000 a\ue000b x", "\xa0 \u3000 a"]


@pytest.mark.parametrize("values", [[], [5], [0, 0, 0], [0, 3, 3, 9, 1000, 10**12], [-(2**63), -1, 0, 2**63 - 1], list(range(0, 5000, 7))])
def test_elias_fano(values):
    ef = tf.EliasFano.encode(np.array(values, np.int64))
    ef, _ = tf.EliasFano.from_buffer(ef.to_bytes(), 0)
    assert [ef.select(i) for i in range(len(values))] == values
    for i in range(0, len(values), 97):
        for j in {i + 1, min(i + 300, len(values)), len(values)}:
            assert ef.select_run(i, j).tolist() == values[i:j]


def test_elias_fano_is_near_minimal():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000))
    bits = 8 * len(tf.EliasFano.encode(bounds).to_bytes()) / len(bounds)
    assert bits < 3 + np.log2(bounds[-1] / len(bounds))


def expected(rows):
    out, start = [], 0
    tok = tf._tokenizer(PATH)
    for d, t in rows:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [3, 1 << 20])
def test_files_hold_what_the_tokenizer_gives(spark, shard_ids):
    rows = [(i * 3 - 4, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(t, "x", d) for d, t in reversed(rows)], "text string, start string, doc_id long")
    out = new_path(spark, "t")
    manifest = tf.write_token_files(df, PATH, out, shard_ids=shard_ids)
    got = sorted(map(tuple, tf.read_token_files(spark, out, manifest).collect()))
    assert got == expected(rows)


def test_a_shard_finds_documents_by_select():
    lengths = [1, 3, 1, 5] * 700
    ids = np.arange(sum(lengths), dtype="<u2")
    names = [None, None, *range(10, 10 + 7 * (len(lengths) - 2), 7)]
    shard = tf.Shard(tf.pack_shard(2, 1, names, lengths, ids.tobytes(), 2))
    ends = np.cumsum(lengths)
    for i in (0, 1, 2, 255, 256, 1000, len(lengths) - 1):
        assert shard[i].tolist() == list(range(ends[i] - lengths[i], ends[i]))
    runs = list(shard.runs(300))
    assert [d for i, j, _ in runs for d in shard.doc_ids(i, j)] == names
    assert np.concatenate([b[1:] for _, _, b in runs]).tolist() == ends.tolist()


def test_results_come_through_select(spark, monkeypatch):
    calls = []
    select_run = tf.EliasFano.select_run
    monkeypatch.setattr(tf.EliasFano, "select_run", lambda self, a, b: calls.append((a, b)) or select_run(self, a, b))
    data = tf.pack_shard(0, 0, [4, 9], [2, 3], np.arange(5, dtype="<u2").tobytes(), 2)
    batch = pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["content"])
    got = pa.Table.from_batches(list(tf._read(iter([batch])))).to_pydict()
    assert got["doc_id"] == [4, 9] and got["local_start"] == [0, 2] and got["n_tokens"] == [2, 3] and calls == [(0, 3), (0, 2)]


def test_a_very_long_text(spark):
    rows = [(1, "a b"), (2, "don't stop the été " * 900_000), (3, None)]
    out = new_path(spark, "t")
    manifest = tf.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), tf.TOKENIZER, out, shard_ids=1000)
    assert sorted(map(tuple, tf.read_token_files(spark, out, manifest).collect())) == expected(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "b a"), (None, "b a"), (2, "c"), (2, "c")], "doc_id long, text string")
    out = new_path(spark, "t")
    got = tf.read_token_files(spark, out, tf.write_token_files(df, PATH, out)).collect()
    assert sorted(r.start for r in got) == [0, 3, 6, 8] and [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 2, 2]
    out = new_path(spark, "t")
    assert tf.read_token_files(spark, out, tf.write_token_files(df.limit(0), PATH, out)).count() == 0


def test_remembered_words_give_what_the_tokenizer_gives():
    texts = [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()] + [t or "" for t in TEXTS]
    texts += ["".join(chr(c) for c in range(k, k + 40)) for k in range(33, 1200, 23)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    enc = tf.WordEncoder(PATH)
    assert enc.straight
    ids, counts = enc.encode(raw, offs)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == enc.tok.encode(t, add_special_tokens=False).ids
        at += n
