import random
import re

import pytest
from llm.conftest import EDGES, WORDS, prose

from tallyforge.llm.components import connected_components
from tallyforge.llm.jaccard_join import near_components, one_of_each


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for x, (i, _) in enumerate(rows):
        groups.setdefault(find(x), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(sets[x]), least[find(x)] if sets[x] else i) for x, (i, _) in enumerate(rows)), key=str)


def drifting(rnd):
    """Copies, near copies, copies that drift apart, and a passage that unrelated texts share."""
    out = list(EDGES)
    for _ in range(25):
        base = [rnd.choice(WORDS) for _ in range(rnd.choice((1, 2, 3, 5, 8, 12, 25, 60, 150, 400)))]
        for _ in range(rnd.choice((1, 2, 5, 12))):
            x = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 6))):
                p, q = rnd.randrange(len(x)), rnd.random()
                x[p : p + 1] = [rnd.choice(WORDS)] if q < 0.5 else [] if q < 0.75 and len(x) > 1 else [x[p], rnd.choice(WORDS)]
            out.append(" ".join(x))
    base, chain = [rnd.choice(WORDS) for _ in range(150)], []
    for k in range(40):
        chain = list(base) if k % 10 == 0 else chain
        chain[rnd.randrange(150)] = rnd.choice(WORDS)
        out.append(" ".join(chain).upper() if k % 3 == 0 else "\t".join(chain))
    passage = prose(rnd, 55)
    return out + [prose(rnd, rnd.choice((3, 10, 40, 120))) + " " + passage for _ in range(40)]


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_against_brute_force(messy, k, num, den):
    texts = drifting(random.Random(k))
    got = near_components(messy(texts), k=k, num=num, den=den).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(enumerate(texts)), k, num, den)


def test_ids_null_repeated_and_empty_table(messy):
    long = prose(random.Random(1), 60)
    rows = [(7, long), (7, long), (None, long), (3, long + " more"), (None, "alone here"), (None, None)]
    docs = messy([t for _, t in rows], [i for i, _ in rows])
    assert sorted(map(tuple, near_components(docs).collect()), key=str) == brute(rows, 5, 80, 100)
    assert near_components(docs.limit(0)).count() == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "None", "None", "None"]


def test_one_of_each(messy):
    texts = drifting(random.Random(9))
    wanted = {c for _, n, c in brute(list(enumerate(texts)), 5, 80, 100)}
    assert {r.doc_id for r in one_of_each(messy(texts)).collect()} == wanted
    twice = messy(["same words in each of these rows"] * 2, [4, 4])
    assert one_of_each(twice).count() == 1


def test_one_id_on_unrelated_texts(messy):
    a, b, c, d, e = (prose(random.Random(k), 60) for k in range(5))
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (5, c), (5, d), (6, e), (6, e + " more"), (6, e), (7, e)]
    kept = sorted((r.doc_id, r.text) for r in one_of_each(messy([t for _, t in rows], [i for i, _ in rows])).collect())
    assert [x for x in kept if x[0] != 6] == sorted([(1, a), (2, b), (5, c), (5, d)])
    assert len(kept) == 5 and kept[-1] in ((6, e), (6, e + " more"))


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 330)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
