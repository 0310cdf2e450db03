import random
import tracemalloc

import numpy as np
import pyarrow as pa
from llm.conftest import EDGES, prose

from tallyforge.llm import quality as quality_module
from tallyforge.llm.quality import CumulativeLink, features, fit, score, select_quality
from tallyforge.llm.textbytes import slices

BAD = ["awful", "nasty", "vile"]


def graded(n, seed):
    """Good prose, poor prose (shouting or marks) and toxic prose."""
    rnd = random.Random(seed)
    texts, quality, toxic = [], [], []
    for _ in range(n):
        words = prose(rnd, rnd.randint(30, 120)).split()
        kind = rnd.choice("ggggpt")
        if kind == "p":
            words = [w.upper() + "!!" for w in words] if rnd.random() < 0.5 else [w + rnd.choice(("###", "%%%")) for w in words]
        if kind == "t":
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(BAD)
        texts.append(" ".join(words))
        quality.append(int(kind != "p"))
        toxic.append(int(kind == "t"))
    return texts, quality, toxic


def test_held_out_accuracy(spark, messy):
    texts, quality, toxic = graded(900, 1)
    labels = spark.createDataFrame([(k, quality[k], toxic[k], "x") for k in range(600)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (9999, 0, 0, "x")], "doc_id long, quality int, toxic int, id string")
    docs = messy(texts)
    kept = select_quality(docs, labels)
    assert kept.columns == [*docs.columns, "expected_grade", "tails_"]
    rows = kept.collect()
    ids = {r.doc_id for r in rows}
    held = range(600, 900)
    good = [k for k in held if quality[k] and not toxic[k]]
    rest = [k for k in held if k not in set(good)]
    assert sum(k in ids for k in good) >= 0.97 * len(good)
    assert sum(k in ids for k in rest) <= 0.05 * len(rest)
    assert all(0 <= r.tails_[1] <= r.tails_[0] <= 1 and abs(sum(r.tails_) - r.expected_grade) < 1e-9 for r in rows)


def test_scores_agree_with_the_model(spark, messy):
    texts, quality, toxic = graded(200, 2)
    texts = [*texts, *EDGES, "long " * 100_000]
    rated = spark.createDataFrame([(k, 0 if toxic[k] else 1 + quality[k]) for k in range(200)], "doc_id long, grade int")
    docs = messy(texts)
    model = fit(docs, rated)
    got = {r.doc_id: list(r.tails_) for r in score(docs, model).collect()}
    for k, text in enumerate(texts):
        ((_, data, offsets),) = slices(pa.array([text], pa.string()))
        row, feature = features(data, offsets)
        np.testing.assert_allclose(got[k], model.tails(np.array([model.weights[feature].sum()]))[0], rtol=1e-9)


def test_thresholds_are_ordered_and_fit_is_repeatable(spark, messy):
    texts, quality, toxic = graded(150, 3)
    rated = spark.createDataFrame([(k, 0 if toxic[k] else 1 + quality[k]) for k in range(150)], "doc_id long, grade int")
    a, b = fit(messy(texts), rated), fit(messy(texts).repartition(2), rated)
    assert a.thresholds[0] <= a.thresholds[1]
    np.testing.assert_array_equal(a.weights, b.weights)
    bounded = fit(messy(texts), rated, most=10)
    assert np.count_nonzero(bounded.weights) < np.count_nonzero(a.weights)


def test_fit_holds_little_memory(monkeypatch):
    """All arrays of the fit together take less than 32 bytes a feature, and the blocks in which it adds up have no part in the result."""
    rnd = np.random.default_rng(4)
    n = 4000
    key = np.unique(np.repeat(np.arange(n), 250) << 18 | (200_000 * rnd.random(250 * n) ** 3).astype(np.int64))
    rows, feature, grades = (key >> 18).astype(np.int32), (key & (1 << 18) - 1).astype(np.int32), rnd.integers(0, 3, n)
    tracemalloc.start()
    try:
        model = CumulativeLink.fit(rows, feature, grades, 3, rounds=3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 * len(rows)
    mixed = rnd.permutation(len(rows))
    np.testing.assert_allclose(CumulativeLink.fit(rows[mixed], feature[mixed], grades, 3, rounds=3).weights, model.weights, rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(quality_module, "_BLOCK", 777)
    np.testing.assert_array_equal(CumulativeLink.fit(rows, feature, grades, 3, rounds=3).weights, model.weights)


def test_no_labels_and_empty_table(spark, messy):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = messy(EDGES)
    tails = {tuple(r.tails_) for r in score(docs, fit(docs, none.selectExpr("doc_id", "quality AS grade"))).collect()}
    assert len(tails) == 1
    assert select_quality(docs.limit(0), none).count() == 0
    assert CumulativeLink.fit(np.zeros(0, int), np.zeros(0, int), np.array([1, 1]), 3).tails(np.zeros(1)).shape == (1, 2)


def test_fit_against_a_plain_optimiser():
    """The penalised likelihood of the fit is close to the best that plain descent with numeric gradients finds on a small problem."""
    rnd = np.random.default_rng(5)
    n, m = 240, 4
    x = rnd.random((n, m)) < 0.4
    latent = x @ np.array([2.0, -1.5, 1.0, 0.0]) + rnd.logistic(size=n)
    grades = np.digitize(latent, [-0.5, 1.0])
    rows, feature = np.nonzero(x)
    model = CumulativeLink.fit(rows, feature, grades, 3, shrink=0.0, rounds=600)
    size = np.bincount(grades, minlength=3)
    weight = np.minimum(4, size.max() / size)[grades]
    weight = weight / weight.sum()

    def loss(p):
        w, (low, gap) = p[:m], p[m:]
        cut = np.array([-np.inf, low, low + np.exp(gap), np.inf])
        below = lambda t: 1 / (1 + np.exp(-np.clip(t - x @ w, -60, 60)))
        return -(weight * np.log(np.maximum(below(cut[grades + 1]) - below(cut[grades]), 1e-12))).sum()

    p, step = np.zeros(m + 2), 1e-5
    for _ in range(3000):
        grad = np.array([(loss(p + step * e) - loss(p - step * e)) / (2 * step) for e in np.eye(m + 2)])
        p = p - 0.5 * grad
    mine = np.append(model.weights[:m], [model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])])
    assert loss(mine) <= loss(p) + 1e-3
    np.testing.assert_allclose(mine[:m], p[:m], atol=0.15)
