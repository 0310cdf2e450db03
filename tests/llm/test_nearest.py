
import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm.nearest import search
from tallyforge.llm.posting_lists import fit_index, unit


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 3) for i, v in rows], "vec_id long, embedding array<float>, vector string, list int").repartition(3)


def exact(rows, query, k):
    """Nearest by brute force over usable vectors of the common length."""
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float32).astype(np.float64)
    q = v[list(ids).index(query)]
    score = (v * q).sum(axis=1) / np.sqrt((v * v).sum(axis=1) * (q * q).sum())
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != query][:k]
    return [(int(ids[j]), score[j]) for j in order]


def test_recall_and_scores(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(30, 24))
    rows = [(k, (centres[k % 30] + 0.6 * rnd.normal(size=24)).astype(np.float32).tolist()) for k in range(3000)]
    rows += [(10_000 + k, rows[50][1]) for k in range(400)]  # a hot vector
    got = {}
    for r in search(table(spark, rows), F.col("vec_id") % 50 == 0, k=5, lists=40, probes=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(got) == sum(i % 50 == 0 for i, _ in rows)
    hits = 0
    for query, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        wanted = exact(rows, query, 5)
        hits += len({i for _, i, _ in found} & {i for i, _ in wanted})
        if [i for _, i, _ in found] == [i for i, _ in wanted]:
            np.testing.assert_allclose([s for _, _, s in found], [s for _, s in wanted], rtol=0, atol=1e-12)
    assert hits / (5 * len(got)) >= 0.9
    assert [i for _, i, _ in sorted(got[50])] == [10_000, 10_001, 10_002, 10_003, 10_004]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1, 0, 0]), (1, [1, 1, 0]), (2, [0, 0, 0]), (3, None), (4, [1, None, 0]), (5, [float("nan"), 0, 0]), (6, [float("inf"), 0, 0]), (7, [1, 0]), (None, [1, 0, 0]), (50, [0, 0, 0]), (8, [])]
    got = search(table(spark, rows), F.col("vec_id") % 50 == 0, k=5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)] and abs(got[0].score - 0.5**0.5) < 1e-12
    assert search(table(spark, rows).limit(0), F.lit(True)).count() == 0
    assert search(table(spark, [(3, None)]), F.lit(True)).count() == 0


def test_ties_and_repeats(spark):
    rows = [(k, [1.0, 2.0]) for k in range(10)] + [(100, [2.0, 4.0]), (100, [2.0, 4.0])]
    got = search(table(spark, rows), F.col("vec_id").isin(0, 100), k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 0) == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 100) == [(1, 0), (2, 1), (3, 2)]


def test_rows_repeated_more_than_k_times(spark):
    rows = [(3, [1.0, 2.0])] * 9 + [(k, [1.0, 2.0]) for k in (10, 11, 12)] + [(5, [2.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in search(table(spark, rows), F.col("vec_id").isin(3, 5), k=3).collect())
    assert got == [(3, 1, 10), (3, 2, 11), (3, 3, 12), (5, 1, 3), (5, 2, 10), (5, 3, 11)]


def test_many_vectors_of_equal_cosine(spark):
    """Scaled copies are distinct vectors of one cosine; of more than fit, the smallest ids count, wherever they stand."""
    rows = [(1000 - k, [2.0**k, 2.0 ** (k + 1), 2.0 ** (k + 2)]) for k in range(40)] + [(k, [1.0, 0.1 * k, 0.3]) for k in range(20)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in search(table(spark, rows), F.col("vec_id").isin(1000, 961), k=5).collect())
    assert got == [(961, r, 961 + r) for r in range(1, 6)] + [(1000, r, 960 + r) for r in range(1, 6)]


def test_index():
    rnd = np.random.default_rng(1)
    sample = unit(rnd.normal(size=(4000, 16)).astype(np.float32))
    index = fit_index(sample, 50)
    home = (sample @ index.centroids.T).argmax(axis=1)
    sizes = np.bincount(home, minlength=50)
    assert sizes.max() < 3 * sizes.mean()
    found, distance = index.nearest(sample[:200], 5)
    true = np.argsort(-(sample[:200] @ index.centroids.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, true)]) > 4.5
    assert (np.diff(distance, axis=1) >= 0).all()
    rows, lists = index.assign(sample)
    assert set(rows) == set(range(4000)) and len(rows) > 4000 and len(set(zip(rows, lists))) == len(rows)
    assert len(fit_index(sample[:1], 50).centroids) == 1
