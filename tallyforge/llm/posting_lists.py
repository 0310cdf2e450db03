"""The index of the nearest-neighbour search: balanced posting lists under a graph of centroids.

Fitted on a bounded sample of unit vectors. ``fit_index`` clusters it into lists of about equal size: after k-means, lists that are too
full get a handicap until sizes settle. Each centroid has edges to near centroids, in both directions, and searches walk that graph best
first for many vectors at a time. A vector goes to the nearest list and, at a boundary, to further lists whose distance is within a
ratio, unless a list chosen before is nearer to that list than the vector is. A query reads the lists within a distance ratio of its nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


@dataclass
class PostingIndex:
    """Centroids (unit length) and their graph: ``edges[i]`` are neighbours of i, padded with i."""

    centroids: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    def nearest(self, vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found and their distances, nearest first, by best-first walks side by side."""
        n, c = len(vectors), len(self.centroids)
        width = min(width, c)
        best = np.full((n, width), -1, np.int64)
        score = np.full((n, width), -np.inf, np.float32)
        expanded = np.zeros((n, width), bool)
        seen = np.zeros((n, c), bool)
        fresh = np.broadcast_to(self.entries, (n, len(self.entries)))
        active = np.arange(n)
        while len(active):
            # Score what is new of the neighbours, and keep the best found so far.
            new = ~seen[active[:, None], fresh]
            seen[active[:, None], fresh] = True
            s = np.einsum("nd,nkd->nk", vectors[active], self.centroids[fresh])
            s[~new] = -np.inf
            s = np.where(_first_of_row(fresh), s, -np.inf)
            every = np.concatenate([score[active], s], axis=1)
            who = np.concatenate([best[active], fresh], axis=1)
            done = np.concatenate([expanded[active], np.zeros(s.shape, bool)], axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :width]
            score[active], best[active], expanded[active] = (np.take_along_axis(x, order, 1) for x in (every, who, done))
            left = ~expanded[active] & (score[active] > -np.inf)
            some = left.any(axis=1)
            active, left = active[some], left[some]
            if len(active):
                at = left.argmax(axis=1)
                expanded[active, at] = True
                fresh = self.edges[best[active, at]]
        distance = np.sqrt(np.maximum(0, 2 - 2 * score))
        return best, np.where(score > -np.inf, distance, np.inf)

    def assign(self, vectors: np.ndarray, *, copies: int = 6, ratio: float = 1.15) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) of all postings of unit vectors."""
        lists, distance = self.nearest(vectors, max(4 * copies, 16))
        chosen = np.zeros(lists.shape, bool)
        chosen[:, 0] = True
        for j in range(1, lists.shape[1]):
            ok = (distance[:, j] <= ratio * distance[:, 0]) & (chosen.sum(axis=1) < copies)
            for i in range(j):
                between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nd->n", self.centroids[lists[:, i]], self.centroids[lists[:, j]])))
                ok &= ~chosen[:, i] | (between > distance[:, j])
            chosen[:, j] = ok
        rows, at = np.nonzero(chosen)
        return rows, lists[rows, at]

    def probe(self, queries: np.ndarray, *, most: int = 64, ratio: float = 1.4, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of the lists that unit queries read: the ``least`` nearest, and those within the ratio."""
        lists, distance = self.nearest(queries, max(most, least))
        near = distance <= ratio * np.maximum(distance[:, :1], 1e-3)
        near[:, :least] = np.isfinite(distance[:, :least])
        rows, at = np.nonzero(near)
        return rows, lists[rows, at]


def _first_of_row(x: np.ndarray) -> np.ndarray:
    """Whether an entry is the first of its value in its row."""
    order = np.argsort(x, axis=1, kind="stable")
    ranked = np.take_along_axis(x, order, 1)
    first = np.ones(x.shape, bool)
    first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    out = np.empty_like(first)
    np.put_along_axis(out, order, first, 1)
    return out


def fit_index(sample: np.ndarray, lists: int, *, degree: int = 16, rounds: int = 12, seed: int = 7) -> PostingIndex:
    """``sample``: unit vectors, at least one."""
    rnd = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centroids = sample[rnd.choice(len(sample), lists, replace=False)].copy()
    handicap = np.zeros(lists, np.float32)
    for k in range(rounds):
        home = np.empty(len(sample), np.int64)
        for a in range(0, len(sample), 4096):
            home[a : a + 4096] = (sample[a : a + 4096] @ centroids.T - handicap).argmax(axis=1)
        size = np.bincount(home, minlength=lists)
        total = np.zeros((lists, sample.shape[1]))
        np.add.at(total, home, sample)
        length = np.sqrt((total * total).sum(axis=1))
        ok = (size > 0) & (length > 0)
        centroids[ok] = (total[ok] / length[ok, None]).astype(np.float32)
        centroids[~ok] = sample[rnd.integers(0, len(sample), (~ok).sum())]
        if k >= rounds // 3:
            handicap += 0.02 * np.clip(size * lists / len(sample) - 1, -1, 2).astype(np.float32)
    near = np.empty((lists, min(degree, lists - 1) if lists > 1 else 0), np.int64)
    for a in range(0, lists, 1024):
        s = centroids[a : a + 1024] @ centroids.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near[a : a + 1024] = np.argsort(-s, axis=1, kind="stable")[:, : near.shape[1]]
    both = [[] for _ in range(lists)]
    for i, row in enumerate(near):
        for j in row:
            both[i].append(j)
            both[j].append(i)
    # A few edges at random keep the graph in one piece.
    for i in range(lists):
        both[i] += list(rnd.integers(0, lists, 2)) + [(i + 1) % lists]
    wide = 3 * degree
    edges = np.array([(list(dict.fromkeys(b)) + [i] * wide)[:wide] for i, b in enumerate(both)], np.int64).reshape(lists, wide)
    middle = (centroids @ centroids.mean(axis=0)).argmax()
    entries = np.unique(np.append(rnd.choice(lists, min(8, lists), replace=False), middle))
    return PostingIndex(centroids, edges, entries)
