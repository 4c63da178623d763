import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from pedalflow.llm import trie

COLUMNS = [*trie.NODE, "ends_sha256"]


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lead = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(lead, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if whole[c] == p).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def nodes(spark, rows, **options):
    found = trie.prefix_trie(trie.rebuilt(trie.encoded(spark.createDataFrame(rows, SCHEMA))), **options)
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    out = []
    for c in range(-30, 330):
        if rnd.random() < 0.9:
            for t in range(rnd.choice((1, 1, 2, 3, 5, 9))):
                out.append((c, t, rnd.choice(("user", "assistant")), rnd.choice(("a b", "a  b", "", "ä\nö ü", "x"))))
    # Copies, a long common prefix, a conversation much longer than the others.
    for c in range(1000, 1040):
        out += [(c, t, "user", f"same {t}") for t in range(12)] + ([(c, 12, "user", str(c % 7))] if c % 3 else [])
    out += [(2000, t, "user", f"long {t // 2}") for t in range(500)]
    return out + [(None, 0, "user", "x"), (5, None, None, None), (5, None, "user", "first"), (7, 3, None, "x"), (7, 3, "user", None), (3001, 1, "user", "alone"), (3002, 1, "user", "alone")] + out[:4]


@pytest.mark.parametrize("local", [1, 40, 4096])
def test_against_brute_force(spark, rows, local):
    assert nodes(spark, rows, local_turns=local) == brute(rows)


def test_sql_agrees(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.execute(trie.SQL)
    columns = [c[0] for c in found.description]
    assert sorted((tuple(r[columns.index(c)] for c in COLUMNS) for r in found.fetchall()), key=str) == brute(rows)


def test_empty_turnless_and_clashing(spark):
    assert nodes(spark, []) == []
    # Conversations 21 and 22 have fewer turns than they lose, and there is no conversation 20.
    few = [(c, 0, "user", "x") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    assert nodes(spark, few) == brute(few) and len(brute(few)) == 1
    df = spark.createDataFrame([(1, 0, "u", "a", 5, "k")], SCHEMA + ", pos int, KEY string")
    assert [r.conv_id for r in trie.encoded(df).collect()] == [1]


def test_very_long_texts_and_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 50)
    text = "word " * 400_000
    rows = [(c, t, "user", text if t == 1 else "hello") for c in range(100, 160) for t in range(3)]
    assert nodes(spark, rows) == brute(rows)


def test_grow_parts_by_next_turn():
    found = trie.grow([(3, 1, "e3", [1, 2], [4, 5]), (1, 2, "e1", [1], [4]), (2, 1, "e2", [1, 9, 9], [4, 7, 7])], 1)
    assert [x[0] for x in found] == [1, 1, None, 4, 2, 2, 12, "e1"]
    assert sorted(zip(*found[:5], strict=True), key=str)[1:] == [(2, 2, 1, 1, 1), (2, 3, 2, 1, 0), (3, 2, 1, 1, 0)]
