import hashlib
import random
import re

import numpy as np
import pytest

from pedalflow.llm import substring
from pedalflow.llm.fm_index import FmIndex


def brute(rows):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - 12):
            if d is not None:
                g = tuple(w[i : i + 13])
                least[g] = min(least.get(g, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeÄ") for _ in range(rnd.choice((1, 2, 4))))
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 40, 90)]
    out = []
    for i in range(150):
        w = []
        for _ in range(rnd.randrange(4)):
            w += [word() for _ in range(rnd.randrange(30))]
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            w += p[a:] if rnd.random() < 0.4 else p
        out.append((i * 7 % 150, "  ".join(w) + "\n"))
    out += [(400 + i, out[i][1]) for i in range(30)]
    out += [(500, None), (501, ""), (502, " \t"), (None, out[3][1]), (None, out[3][1]), (7, out[1][1]), (600, "z " * 400), (601, "z " * 60), (-3, " ".join(passages[4])), (602, " ".join(passages[3]).upper())]
    return out + out[:5]


@pytest.mark.parametrize("shard,hot", [(600_000, 2000), (60, 2000), (60, 2), (600_000, 20)])
def test_against_brute_force(spark, rows, monkeypatch, shard, hot):
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring, "HOT_PLACES", hot)
    df = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, kept string, starts int")
    out = substring.remove_repeats(df, with_text=False)
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=str)
    assert got == brute(rows)


def test_texts_come_back_and_empty_table(spark):
    p = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"a {p} b"), (2, f"c\n{p}  d")], "doc_id long, text string")
    got = {r.row.doc_id: r.kept for r in substring.remove_repeats(df).collect()}
    assert got == {1: f"a {p} b", 2: "c d"}
    assert substring.remove_repeats(df.limit(0)).count() == 0


def occurrences(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()]


@pytest.mark.parametrize("least", [1, 2, 5])
def test_matching_statistics(least):
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 5, n), 0) for n in (30, 1, 200, 70)])
    index = FmIndex(text)
    for stream in (text, np.concatenate([rng.integers(1, 7, 60), text[40:60], [0, 9], text[3:25]])):
        length, low, high = index.matching(stream, 13, least)
        for e in range(len(stream)):
            held = lambda n: 0 not in stream[e - n + 1 : e + 1] and len(occurrences(text, stream[e - n + 1 : e + 1])) >= least  # noqa: B023, E731
            want = 0
            while want < 13 and want <= e and held(want + 1):
                want += 1
            assert length[e] == want
            if want:
                assert high[e] - low[e] == len(occurrences(text, stream[e - want + 1 : e + 1]))


def test_one_interval_for_equal_windows_alone():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (100, 300)])
    length, low, _ = FmIndex(text).matching(text, 4, 1)
    names = {}
    for e in np.flatnonzero(length == 4):
        names.setdefault(int(low[e]), set()).add(tuple(text[e - 3 : e + 1]))
    assert all(len(x) == 1 for x in names.values()) and len({x.pop() for x in names.values()}) == len(names)


def test_holders_come_from_the_matching_statistics(monkeypatch):
    asked = []
    matching = FmIndex.matching
    monkeypatch.setattr(FmIndex, "matching", lambda self, *a: asked.append(a[1:]) or matching(self, *a))
    passage, other = np.arange(1, 15, dtype=np.uint64), np.arange(50, 70, dtype=np.uint64)
    found, begin, length = substring.smallest_holders([x.tobytes() for x in (np.append(passage, np.uint64(99)), other, passage)], np.array([7, 3, 5]))
    assert asked == [(13, 2)] and length.tolist() == [15, 20, 14]
    assert found[begin[0] : begin[0] + 3].tolist() == [5, 5, 7] and found[begin[2] : begin[2] + 2].tolist() == [5, 5] and set(found[begin[1] : begin[1] + 8].tolist()) == {3}
    # Without its intervals no window has another holder.
    monkeypatch.setattr(FmIndex, "matching", lambda self, s, *a: (np.zeros(len(s), np.int64),) * 3)
    found, begin, _ = substring.smallest_holders([x.tobytes() for x in (np.append(passage, np.uint64(99)), passage)], np.array([7, 5]))
    assert found[begin[0]] == 7


def test_a_very_long_text(spark):
    rnd = random.Random(8)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(250_000))
    rows = [(2, long), (1, " ".join(long.split()[1000:1040])), (3, " ".join(long.split()[200_000:200_013]) + " x"), (4, "y"), (2, long)]
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()), key=str)
    assert got == brute(rows)


def test_anchors_cover_every_window_once():
    from pedalflow.llm.words import split

    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 5, 12, 13, 14, 200, 3, 60)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    words = split(raw, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    _, doc, first, count = substring.anchors(words)
    got = [(d, f + k) for d, f, c in zip(doc.tolist(), first.tolist(), count.tolist(), strict=True) for k in range(c)]
    assert got == [(d, i) for d, t in enumerate(texts) for i in range(len(t.split()) - 12)]
    assert count.max() <= substring.WINDOW - substring.GRAM + 1


def test_an_anchor_of_two_texts_and_very_many_places_fills_no_shard(spark, monkeypatch):
    """Both texts hold one run of five words again and again, each time among other words."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = [" ".join(x for _ in range(1500) for x in ["a", "b", "c", "d", "e", *(word() for _ in range(6))]) for _ in range(2)]
    shared = " ".join(word() for _ in range(20))
    rows = [(1, f"{texts[0]} {shared}"), (2, f"{texts[1]} {shared}")]
    sizes = []
    holders = substring.smallest_holders
    monkeypatch.setattr(substring, "SHARD_WORDS", 1000)
    monkeypatch.setattr(substring, "HOT_PLACES", 200)
    monkeypatch.setattr(substring, "smallest_holders", lambda s, d: sizes.append(sum(len(x) // 8 for x in s)) or holders(s, d))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, with_text=False).collect()), key=str)
    assert got == brute(rows) and got[1][2] >= 20
    pieces = [b for batch in substring_shards(df) for b in batch]
    assert max(pieces) <= 200 * 21


def substring_shards(df):
    """Words of each route that goes to shards."""
    kept = []
    run = substring.materialise

    def watch(frame, name):
        table = run(frame, name)
        if name == "substring-pieces":
            kept.append([r.n for r in table.where("words is not null").groupBy("route").agg({"words": "count"}).withColumnRenamed("count(words)", "n").collect()])
            kept.append([r.n // 8 for r in table.where("words is not null").selectExpr("route", "octet_length(words) n").groupBy("route").sum("n").withColumnRenamed("sum(n)", "n").collect()])
        return table

    substring.materialise = watch
    try:
        substring.remove_repeats(df, with_text=False).collect()
    finally:
        substring.materialise = run
    return kept
