import hashlib
import random

import duckdb
import numpy as np
import pytest

from pedalflow.llm import byte_repeats, suffix_blocks


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in texts:
        if d is not None:
            for i in range(len(b) - 49):
                g = b[i : i + 50]
                least[g] = min(least.get(g, d), d)
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 2, bool)
        if d is not None:
            for i in range(len(b) - 49):
                if least[b[i : i + 50]] < d:
                    gone[i + 1 : i + 51] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(df):
    rows = byte_repeats.remove_byte_repeats(df).collect()
    return sorted(((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdeÄ€ \n") for _ in range(n))
    passages = [text(n) for n in (45, 49, 50, 51, 77, 300)]
    out = []
    for i in range(150):
        t = ""
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            t += text(rnd.randrange(90)) + (p[rnd.randrange(len(p)) :] if rnd.random() < 0.4 else p)
        out.append((i * 7 % 150, t))
    out += [(400 + i, out[i][1]) for i in range(30)]
    out += [(500, None), (501, ""), (502, "x" * 49), (503, "x" * 50), (None, out[3][1]), (None, out[3][1]), (600, "z" * 400), (601, "z" * 60), (602, "zy" * 200), (604, "zy" * 150 + "a"), (-3, passages[5]), (603, "\0" * 60), (605, "\0" * 70)]
    return out + out[:5]


@pytest.mark.parametrize("shard,hot,chunk,pack", [(4 << 20, 30_000, 1 << 18, 8 << 20), (60, 30_000, 1 << 18, 500), (60, 2, 300, 2000), (4 << 20, 20, 70, 8 << 20)])
def test_against_brute_force(spark, rows, monkeypatch, shard, hot, chunk, pack):
    for name, value in (("SHARD_BYTES", shard), ("HOT_PLACES", hot), ("CHUNK", chunk), ("PACK_BYTES", pack), ("ROUTE_ANCHORS", 100)):
        monkeypatch.setattr(byte_repeats, name, value)
    df = spark.createDataFrame([(t, d, 1, "x", 2) for d, t in rows], "text string, doc_id long, kept int, row string, SPANS int")
    assert removed(df) == brute(rows)


def test_sql_agrees(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    plain = [r for r in dict.fromkeys(rows) if r[0] is not None]
    con.executemany("insert into documents values (?, ?)", plain)
    found = con.execute(byte_repeats.SQL)
    assert [c[0] for c in found.description] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(found.fetchall(), key=str) == brute(plain)


def test_kept_bytes_other_columns_and_empty_table(spark):
    p = "".join(chr(97 + i % 26) * (i % 3 + 1) for i in range(60))
    df = spark.createDataFrame([(1, f"a {p} b", 5), (2, f"c{p}d", 6)], "doc_id long, text string, n_bytes int")
    got = {r.row.doc_id: (r.row.n_bytes, r.kept) for r in byte_repeats.remove_byte_repeats(df).collect()}
    assert got == {1: (5, f"a {p} b".encode()), 2: (6, b"cd")}
    assert byte_repeats.remove_byte_repeats(df.limit(0)).count() == 0
    assert removed(df.where("doc_id = 1")) == brute([(1, f"a {p} b")])


def test_a_very_long_text(spark):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(2, long), (1, long[1000:1060]), (3, long[1_200_000:1_200_050] + "x"), (4, "y"), (2, long)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
def test_suffixes_come_in_order(letters):
    rng = np.random.default_rng(letters)
    for n in (16, 17, 60, 300, 900):
        text = rng.integers(0, letters, n).astype(np.uint8)
        text = np.concatenate((text, text, text[: n // 2]))
        wanted = np.sort(rng.choice(len(text) - 16, min(len(text) - 16, 500), replace=False))
        got = np.concatenate(list(suffix_blocks.buckets(text, wanted, 40)))
        assert got.tolist() == sorted(wanted.tolist(), key=lambda i: text.tobytes()[i:])  # noqa: B023


def test_cover_leads_every_pair_into_the_sample():
    p, cover = suffix_blocks.PERIOD, suffix_blocks.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p))
    assert all((r + suffix_blocks.STEP[r, s]) % p in cover and (s + suffix_blocks.STEP[r, s]) % p in cover for r in range(p) for s in range(p))


def test_runs_hold_every_window_once_and_equal_windows_share_a_key():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 5, 49, 50, 51, 400, 3, 130)] + ["a" * 300]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    keys, seen = {}, []
    for doc, start, count, key in byte_repeats.runs(raw, offs):
        assert count.max() <= byte_repeats.SPAN
        for d, s, c, k in zip(doc.tolist(), start.tolist(), count.tolist(), key.tolist(), strict=True):
            for i in range(s, s + c):
                seen.append((d, i))
                assert keys.setdefault(texts[d][i : i + 50], k) == k
    assert seen == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)]
