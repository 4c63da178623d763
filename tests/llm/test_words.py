import re

import numpy as np
import pyarrow as pa
import pytest

from pedalflow.llm import words as w

TEXTS = ["a bb  ccc\n", "", "x" * 9000 + " bb", " \t", "É漢 bb\x0b\x0cZ", "bb" * 2048 + " " + "bb" * 2049]


def of(texts, lower=False):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    return w.split(raw, np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))), lower)


@pytest.mark.parametrize("lower", [False, True])
def test_words_are_those_of_the_pattern(lower):
    found = of(TEXTS, lower)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for d, t in enumerate(TEXTS):
        got = [bytes(found.data[found.starts[i] : found.ends[i]]).decode() for i in range(found.offsets[d], found.offsets[d + 1])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t.translate(low) if lower else t)


def test_a_word_has_one_hash_wherever_it_stands():
    together, seen = of(TEXTS), {}
    for d, t in enumerate(TEXTS):
        alone = of([t])
        assert alone.hashes.tolist() == together.hashes[together.offsets[d] : together.offsets[d + 1]].tolist()
        for i in range(len(alone.hashes)):
            seen.setdefault(bytes(alone.data[alone.starts[i] : alone.ends[i]]), set()).add(int(alone.hashes[i]))
    assert all(len(h) == 1 for h in seen.values()) and len({next(iter(h)) for h in seen.values()}) == len(seen)


def test_runs_stay_inside_their_documents():
    texts = ["a b c d", "a b", "", "b c d a b c"]
    found, begins = w.grams(of(texts), 3)
    assert np.diff(begins).tolist() == [2, 0, 0, 4]
    assert found[1] == found[begins[3]] and found[0] == found[begins[3] + 3] and len(set(found.tolist())) == 4


def test_nulls_slices_and_compact_words():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1)
    raw, offs = w.text_buffers(column)
    assert np.diff(offs).tolist() == [0, 1, 5]
    assert list(w.slices(offs, 1)) == [(0, 2), (2, 3)]
    compact, begins = w.compact_words(raw, offs)
    assert compact.to_pylist() == ["c", "d", "e", "f"] and begins.tolist() == [0, 0, 1, 4]
