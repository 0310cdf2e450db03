import hashlib
import random
from collections import Counter

import pytest
from llm.conftest import EDGES, prose

from tallyforge.llm import suffix_dedup
from tallyforge.llm.bwt import repeat_groups
from tallyforge.llm.suffix_dedup import digest, remove_repeats


def test_repeats_of_small_strings():
    rnd = random.Random(2)
    for _ in range(300):
        k = rnd.choice((1, 2, 3, 5, 8))
        strings = [bytes(rnd.choice(b"ab\x00\xff"[: rnd.choice((1, 2, 4))]) for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(0, 6))]
        starts = [s[i : i + k] if i + k <= len(s) else None for s in strings for i in range(len(s))]
        count = Counter(x for x in starts if x)
        groups = repeat_groups(strings, k)
        assert [g >= 0 for g in groups] == [x is not None and count[x] > 1 for x in starts]
        same = {}
        for g, x in zip(groups, starts):
            if g >= 0:
                assert same.setdefault(g, x) == x
        assert len(set(same.values())) == len(same)


def brute(rows, least=200):
    count = Counter(b[i : i + least] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - least + 1))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(7)
    passages = [prose(rnd, rnd.choice((30, 36, 40, 45, 60, 90))) for _ in range(12)]
    out = list(EDGES)
    for _ in range(160):
        q = rnd.random()
        if q < 0.55:
            text = prose(rnd, rnd.randint(0, 60)) + rnd.choice(("", " ")) + rnd.choice(passages[:3] if q < 0.3 else passages) + rnd.choice(("", " ")) + prose(rnd, rnd.randint(0, 60))
            out.append(text[: len(text) // 2] + "#" + text[len(text) // 2 :] if rnd.random() < 0.3 else text)
        elif q < 0.65:
            out.append(prose(rnd, 3) * rnd.randint(1, 80))
        elif q < 0.72:
            out.append("a" * rnd.choice((10, 199, 200, 201, 400, 3000)))
        else:
            out.append(prose(rnd, rnd.randint(0, 200)))
    out += [rnd.choice(out) for _ in range(15)] + ["é" * 150, prose(rnd, 30_000)]
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_against_brute_force(messy, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = corpus()
    got = digest(remove_repeats(messy(texts))).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(enumerate(texts)))


def test_ids_spans_and_empty_table(messy):
    long = prose(random.Random(1), 60)
    rows = [(1, long), (1, long), (None, "x" + long), (None, None)]
    docs = messy([t for _, t in rows], [i for i, _ in rows])
    assert sorted(map(tuple, digest(remove_repeats(docs)).collect()), key=str) == brute(rows)
    whole = [r for r in remove_repeats(docs).collect() if r.doc_id is None and r.n_bytes]
    assert [(s.start, s.end) for s in whole[0].spans] == [(1, len(long) + 1)] and bytes(whole[0].kept) == b"x"
    assert remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, least=50)
