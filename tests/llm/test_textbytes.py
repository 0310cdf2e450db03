import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm.textbytes import SPACED, shingles, slices, words

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from([*"abAB \t\n\r\x00\x01\x1c.", chr(0x85), chr(0xA0), chr(0xE9), chr(0x1F600)]), max_size=25)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 40), st.integers(1, 4))
def test_words_and_shingles(texts, most, k):
    seen_words, seen_sets, names, grams_of = [], [], {}, {}
    for first, data, offsets in slices(pa.array(texts, pa.string()), most):
        n = len(offsets) - 1
        rows, starts, lengths, hashes = words(data, offsets, SPACED)
        for r, a, length, h in zip(rows, starts, lengths, hashes):
            word = re.sub(b"[A-Z]", lambda m: m[0].lower(), data[a : a + length].tobytes())
            assert names.setdefault(h, word) == word
            seen_words.append((first + r, word))
        srow, grams = shingles(rows, hashes, k, n)
        seen_sets += list(zip(first + srow, grams))
    plain = [[re.sub(b"[A-Z]", lambda m: m[0].lower(), w.encode()) for w in re.findall(r"[^\x20\x09-\x0d]+", t or "")] for t in texts]
    assert seen_words == [(r, w) for r, ws in enumerate(plain) for w in ws]
    wanted = [{tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set() for ws in plain]
    counts = np.bincount([r for r, _ in seen_sets], minlength=len(texts)) if seen_sets else np.zeros(len(texts), int)
    assert list(counts) == [len(s) for s in wanted]
    for r, g in seen_sets:
        grams_of.setdefault(r, set()).add(g)
    for a in range(len(texts)):
        for b in range(a):
            assert len(grams_of.get(a, set()) & grams_of.get(b, set())) == len(wanted[a] & wanted[b])


def test_words_longer_than_the_table():
    x = "x" * 65_535
    texts = [f"a{x}b", f"b{x}a", f"a{x}b", f"{x}ab", "y " + " " * 70_000 + "z"]
    for most in (1, 1 << 30):
        got = [list(words(data, offsets, SPACED)[3]) for _, data, offsets in slices(pa.array(texts), most)]
        flat = [h for hashes in got for h in hashes]
        assert len(flat) == 6 and flat[0] == flat[2] and len(set(flat)) == 5
