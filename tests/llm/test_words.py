import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from bytegrain.llm._sketch import Sketch, Twice, log2_for
from bytegrain.llm._words import Words, covered, texts

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZz09 é\t\n.K ", max_size=40)), max_size=12)


@given(TEXTS, st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_words_of_pieces(rows, most):
    """Pieces cover all rows in turn; words, lower case and hashes are those of a regular expression."""
    for kind, pattern in (("space", "[^\x20\x09-\x0d]+"), ("alnum", "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")):
        seen, known = [], {}
        for row, data, offsets in texts(pa.array(rows, pa.string()), most):
            assert row == len(seen)
            w = Words(data, offsets, kind, True)
            for i, n in enumerate(w.n_words.tolist()):
                at = int(w.words_at[i])
                seen.append([w.bytes_of(j).decode() for j in range(at, at + n)])
                for j in range(at, at + n):
                    low = w.bytes_of(j).lower()
                    assert known.setdefault(low, w.hash[j]) == w.hash[j]
        assert seen == [re.findall(pattern, t or "") for t in rows] and len(set(known.values())) == len(known)


def test_run_hashes_are_those_of_the_words():
    rows = ["a b c a b c", "b c a", "a b c"]
    ((_, data, offsets),) = texts(pa.array(rows))
    w = Words(data, offsets, "space", False)
    s = w.sums(5)
    first = w.windows(3)
    assert first.tolist() == [0, 1, 2, 3, 6, 9]
    by_words = {}
    for f, h in zip(first.tolist(), w.runs(s, first, first + 3).tolist(), strict=True):
        by_words.setdefault(b" ".join(w.bytes_of(i) for i in range(f, f + 3)), set()).add(h)
    assert len(by_words) == 3 and all(len(h) == 1 for h in by_words.values())
    assert w.runs(s, np.array([0]), np.array([2])) != w.runs(s, np.array([0]), np.array([3]))


def test_covered():
    assert covered(6, np.array([1, 2]), np.array([3, 5])).tolist() == [False, True, True, True, True, False]
    assert covered(3, np.array([], int), np.array([], int)).tolist() == [False] * 3


@given(st.lists(st.integers(0, 50), max_size=200), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_sketch_never_loses_a_repeat(keys, parts):
    """However keys are dealt out, those that occur twice are found; with a wide sketch the others are not."""
    k = np.array(keys, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    log2 = 19
    once, twice = ([np.zeros(1 << log2 - 3, np.uint8) for _ in range(2)] for _ in range(2))
    for p in range(parts):
        s = Sketch(log2)
        for chunk in np.array_split(k[p::parts], 2):
            s.add(chunk)
        for r in range(2):
            twice[r] |= s.twice[r] | (once[r] & s.once[r])
            once[r] |= s.once[r]
    found = Twice(log2, twice).may(k)
    assert all(f for f, x in zip(found, keys, strict=True) if keys.count(x) > 1)


def test_sketch_width_is_bounded():
    assert log2_for(0) == 19 and log2_for(10**15) is None and log2_for(1 << 27) == 28 and log2_for(1 << 20) == 23
