"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document has one score, the sum of the weights of its distinct hashed features (words, the marks stuck to them, and how much of it is
capitals, marks or repetition, each in steps). Ordered thresholds cut the score: P(grade <= k) = logistic(threshold_k - score). That
gives the expected grade, and the tail probability P(grade >= k) by which documents are selected.

The weights are fitted on at most ``MOST_LABELLED`` labelled rows, those whose hashed ids are smallest, by proximal full-batch
gradient steps; only hashed feature numbers of these rows reach the driver, which holds them as 32-bit numbers, by row and by feature, and
adds them up in blocks. Every document is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.textbytes import LETTERED, SPACED, byte_table, give_back, mix, slices, words

#: The bound of the labelled sample, and the number of hashed weights.
MOST_LABELLED, BITS = 12_000, 18
#: Features that the fit takes at a time; it bounds temporary memory and has no part in the result.
_BLOCK = 1 << 16
_MARKS = byte_table(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or b in (32, *range(9, 14))), fold=False)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = LETTERED != 0
_SPACE = SPACED == 0
_U = np.uint64


def _kind(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes ^ _U(kind << 56)) >> _U(64 - BITS)).astype(np.int64)


def _steps(rows: np.ndarray, part: np.ndarray, whole: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that tell the share part / whole in steps of a tenth; all steps up to the share are set."""
    share = np.floor(10 * part / np.maximum(whole, 1)).astype(np.int64)
    r = np.repeat(rows, share)
    first = np.repeat(np.cumsum(share) - share, share)
    return r, _kind((np.arange(len(r)) - first).astype(_U), kind)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a block, sorted."""
    n, size = len(offsets) - 1, np.diff(offsets)
    every = np.arange(n)
    out = []
    rows, _, _, hashes = words(data, offsets, LETTERED)
    out.append((rows, _kind(hashes, 1)))
    same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    counts = np.bincount(rows, minlength=n)
    out.append(_steps(every, np.bincount(rows[1:][same], minlength=n), counts, 3))
    marked, _, _, marks = words(data, offsets, _MARKS)
    out.append((marked, _kind(marks, 2)))
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    out.append(_steps(every, total(_UPPER[data]), total(_LETTER[data]), 4))
    out.append(_steps(every, total(~_LETTER[data] & ~_SPACE[data]), size, 5))
    # Words that occur before in the text, beyond what most texts repeat.
    order = np.lexsort((hashes, rows))
    again = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    out.append(_steps(every, np.bincount(rows[order][1:][again], minlength=n), counts, 6))
    key = np.unique(np.concatenate([(r << BITS) | f for r, f in out]))
    return key >> BITS, key & ((1 << BITS) - 1)


def _blocks(at: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of lists, of about ``_BLOCK`` entries together; list k has the entries at[k] to at[k + 1]."""
    out, first = [], 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _BLOCK, "right")) - 1)
        out.append((first, last))
        first = last
    return out


def _lists(at: np.ndarray, first: int, last: int) -> np.ndarray:
    """The list of each entry of a block, from 0."""
    return np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))


def _sums(values: np.ndarray, entries: np.ndarray, at: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The sum of ``values`` at each list's entries, added in their order. All entries are in range: clipping only spares a check."""
    out = np.zeros(len(at) - 1)
    for a, b in blocks:
        out[a:b] = np.bincount(_lists(at, a, b), values.take(entries[at[a] : at[b]], mode="clip"), minlength=b - a)
    return out


def _turned(entries: np.ndarray, at: np.ndarray, blocks: list[tuple[int, int]], turned_at: np.ndarray) -> np.ndarray:
    """The lists that hold each entry, ascending, one entry after the other; ``turned_at`` is where each begins and ends."""
    out, place = np.empty(len(entries), np.int32), turned_at[:-1].copy()
    for a, b in blocks:
        here = entries[at[a] : at[b]]
        order = np.argsort(here, kind="stable")
        here = here[order]
        first = np.flatnonzero(np.diff(here, prepend=-1))
        size = np.diff(first, append=len(here))
        out[place[here] + np.arange(len(here)) - np.repeat(first, size)] = a + _lists(at, a, b)[order]
        place[here[first]] += size
    return out


@dataclass
class CumulativeLink:
    """Shared weights and ascending thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    @staticmethod
    def fit(rows: np.ndarray, feature: np.ndarray, grades: np.ndarray, n_grades: int, *, rounds: int = 150, rate: float = 0.3, shrink: float = 3e-4, least: int = 5) -> CumulativeLink:
        """Features of fewer than ``least`` rows have no weight; ``shrink`` is the L1 penalty. Needs two grades, or all scores are equal."""
        n = len(grades)
        weights, thresholds = np.zeros(1 << BITS), np.zeros(n_grades - 1)
        if not n:
            return CumulativeLink(weights, np.arange(n_grades - 1, dtype=float))
        share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n
        share = np.clip(share, 1e-3, 1 - 1e-3)
        thresholds = np.maximum.accumulate(np.log(share / (1 - share))) + 1e-3 * np.arange(n_grades - 1)
        if (rows[1:] < rows[:-1]).any():
            order = np.argsort(rows, kind="stable")
            rows, feature = rows[order], feature[order]
        seen = np.zeros(1 << BITS, np.int64)
        for k in range(0, len(feature), _BLOCK):
            seen += np.bincount(feature[k : k + _BLOCK], minlength=1 << BITS)
        used = np.flatnonzero(seen >= max(least, 1))
        number = np.full(1 << BITS, -1, np.int32)
        number[used] = np.arange(len(used), dtype=np.int32)
        column = number[feature]
        keep = column >= 0
        rows, column = rows[keep], column[keep]
        # The same entries twice: the columns of each row, and the rows of each column.
        by_row, by_column = np.searchsorted(rows, np.arange(n + 1, dtype=rows.dtype)), np.concatenate([[0], np.cumsum(seen[used])])
        row_blocks, column_blocks = _blocks(by_row), _blocks(by_column)
        del rows, feature, keep
        row = _turned(column, by_row, row_blocks, by_column)
        w, g2, t2 = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(n_grades - 1, 1e-8)
        # Each grade weighs alike up to a factor of four, so that rare ones count.
        size = np.bincount(grades, minlength=n_grades)
        weight = np.minimum(4, size.max() / np.maximum(size, 1))[grades]
        weight /= weight.sum()
        upper, lower = np.append(thresholds, np.inf), np.insert(thresholds, 0, -np.inf)
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        for _ in range(rounds):
            score = _sums(w, column, by_row, row_blocks)
            upper, lower = np.append(thresholds, np.inf), np.insert(thresholds, 0, -np.inf)
            a, b = sigmoid(upper[grades] - score), sigmoid(lower[grades] - score)
            da, db = a * (1 - a), b * (1 - b)
            p = np.maximum(a - b, 1e-12)
            grad_score = weight * (da - db) / p
            grad = _sums(grad_score, row, by_column, column_blocks)
            at = np.zeros(n_grades - 1)
            for k in range(n_grades - 1):
                at[k] = -(weight * np.where(grades == k, da, 0) / p).sum() + (weight * np.where(grades == k + 1, db, 0) / p).sum()
            g2 += grad**2
            t2 += at**2
            step = rate / np.sqrt(g2)
            w -= step * grad
            w = np.sign(w) * np.maximum(0, np.abs(w) - step * shrink)
            thresholds = np.maximum.accumulate(thresholds - rate * at / np.sqrt(t2))
        weights[used] = w
        return CumulativeLink(weights, thresholds)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label: 0 toxic, 1 poor, 2 good; null where either mark is null."""
    return F.when(toxic == 1, 0).when(toxic.isNull() | quality.isNull(), None).when(quality == 0, 1).otherwise(2)


def fit(docs: DataFrame, rated: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3, most: int = MOST_LABELLED, **how) -> CumulativeLink:
    """Fit on ``rated`` (id_col, grade). Null ids and grades are left out; of several grades of a document the least counts."""
    spark = docs.sparkSession
    labels = rated.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("grade").cast("int").alias("grade"))
    # At most ``most`` rows of two numbers: a bound whatever the table's size.
    sample = labels.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades = batch.column("grade").to_pylist()
            for first, data, offsets in slices(batch.column("text")):
                row, feature = features(data, offsets)
                n = len(offsets) - 1
                at = np.searchsorted(row, np.arange(n + 1))
                lists = [feature[at[k] : at[k + 1]].astype(np.int32).tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, n), pa.array(grades[first : first + n], pa.int32()), pa.array(lists, pa.binary())], ["id", "grade", "features"])

    got = rows.select("id", "grade", "text").mapInArrow(hashed, "id long, grade int, features binary")
    # A repeated id counts once, or copies could outgrow the bound.
    got = got.groupBy("id", "grade").agg(F.min("features").alias("features")).orderBy("id").toArrow()
    grades = np.array(got.column("grade").to_pylist(), np.int64)
    lists = [(np.diff(offsets), data) for chunk in got.column("features").chunks for _, data, offsets in slices(chunk, 1 << 62)]
    size = np.concatenate([np.zeros(0, np.int64), *(n for n, _ in lists)]) // 4
    feature = np.concatenate([np.zeros(0, np.uint8), *(data for _, data in lists)]).view(np.int32)
    del got, lists
    model = CumulativeLink.fit(np.repeat(np.arange(len(size), dtype=np.int32), size), feature, grades, n_grades, **how)
    give_back()
    return model


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it while a column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def score(docs: DataFrame, model: CumulativeLink, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tails`` (P(grade >= 1), P(grade >= 2), ...) as its last columns; where docs has columns of these
    names, they get underscores at their ends. Null text is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    grade = free_name("expected_grade", docs.columns)
    tail = free_name("tails", docs.columns)

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for text in texts:
            out = []
            for _, data, offsets in slices(text):
                row, feature = features(data, offsets)
                out.append(model.tails(np.bincount(row, model.weights[feature], minlength=len(offsets) - 1)))
            flat = np.concatenate(out).ravel() if out else np.zeros(0)
            k = len(model.thresholds)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), pa.array(flat))

    scored_rows = docs.withColumn(tail, F.arrow_udf(scored, "array<double>")(F.col(text_col)))
    return scored_rows.select(*docs.columns, F.aggregate(tail, F.lit(0.0), lambda a, x: a + x).alias(grade), tail)


def select_quality(docs: DataFrame, labels: DataFrame, *, least_grade: int = 2, least_tail: float = 0.35, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """The rows of ``docs`` with P(grade >= least_grade) of at least ``least_tail``, with ``expected_grade`` and ``tails``.

    ``labels`` has id_col, quality and toxic (0 or 1). Null text counts as empty; null ids and repeated rows are scored like others;
    empty ``docs`` gives no rows; without labels every document has the same score.
    """
    rated = labels.select(F.col(id_col), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = fit(docs, rated, id_col=id_col, text_col=text_col, most=most)
    scored = score(docs, model, text_col=text_col)
    return scored.where(F.col(scored.columns[-1])[least_grade - 1] >= least_tail)
