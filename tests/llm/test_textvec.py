import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.textvec import ALNUM, SPACED, gram_hashes, slices

TEXT = st.text(st.sampled_from(list("aAbZ09 \n\t\x0b-_.,é漢 \x1c")), max_size=40)
PATTERNS = [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 60))
def test_words_match_the_patterns(texts, limit):
    for cls, pattern in PATTERNS:
        words, hashes = [], []
        for s in slices(pa.array(texts, pa.string()), cls, limit=limit):
            h = s.hashes()
            for i in range(s.n):
                a, b = s.word_at[i], s.word_at[i + 1]
                words.append([s.data[x:y].tobytes().decode() for x, y in zip(s.start[a:b], s.end[a:b])])
                hashes.append(h[a:b].tolist())
        want = [re.findall(pattern, low(t or "")) for t in texts]
        assert words == want
        flat = dict(zip(sum(words, []), sum(hashes, [])))
        assert [[flat[w] for w in ws] for ws in words] == hashes and len(set(flat.values())) == len(flat)


def test_offsets_of_sliced_arrays():
    a = pa.array(["one two", None, "three", "", "four five six"]).slice(1, 4)
    got = [(s.first + i, int(n)) for s in slices(a, SPACED, limit=1) for i, n in enumerate(s.counts())]
    assert got == [(0, 0), (1, 1), (2, 0), (3, 3)]


def test_grams_depend_on_order():
    w = np.array([3, 5, 3, 5, 7], np.uint64)
    g = gram_hashes(w, 2)
    assert g[0] == g[2] != g[1] and len(gram_hashes(w, 6)) == 0


def test_parts_of_a_long_text_give_the_same_fingerprints(monkeypatch):
    from barloom.llm import textvec

    column = pa.array(["alpha beta " * 50 + "gamma" * 30, "x"])
    whole = [s.hashes() for s in slices(column, SPACED)]
    monkeypatch.setattr(textvec, "PART_BYTES", 20)
    assert all((a == s.hashes()).all() for a, s in zip(whole, slices(column, SPACED)))
