"""Repeated substrings of a minimum length by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

_PACK = 7


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of all strings in ``data``, sorted. ``ends[i]`` is where the string of byte i ends; there stands an end mark of its own, smaller than
    every byte, and marks are ordered by place. Prefix doubling from 7 bytes; only ranks that are still shared are sorted again."""
    n = len(data)
    left = ends - np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(_PACK):
        fits = max(0, n - j)
        inside = left > j
        key <<= 9
        key[:fits] += np.where(inside[:fits], data[j:].astype(np.int64) + 1, 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    own = left[order] < _PACK
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | own[1:] | own[:-1]
    del key, sorted_key
    # A rank is the place of its group's first suffix.
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = head
    step = _PACK
    size = np.diff(np.append(np.flatnonzero(fresh), n))
    shared = np.flatnonzero(np.repeat(size, size) > 1)
    while len(shared):
        who = order[shared]
        group = rank[who]
        # A suffix of just ``step`` bytes goes on with its end mark.
        after = np.where(left[who] == step, who, n + rank[np.minimum(who + step, n - 1)])
        by = np.argsort((group << 32) | after, kind="stable")
        who, group, after = who[by], group[by], after[by]
        order[shared] = who
        fresh = np.ones(len(who), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head = np.maximum.accumulate(np.where(fresh, shared, 0))
        rank[who] = head
        step *= 2
        size = np.diff(np.append(np.flatnonzero(fresh), len(who)))
        shared = shared[np.repeat(size, size) > 1]
    return order


def repeat_groups(strings: list[bytes], least: int) -> np.ndarray:
    """For each byte of the strings' concatenation: a number that starts of one substring of ``least`` bytes share, or -1 where no
    other start has the same substring.

    Rows of the transform are the suffixes in order, the end marks before all. A row's boundary to the row above has the length of their
    common prefix. At the start, only rows with different first symbols are bounded, at 0. If a boundary of value v lies between a row
    and the last row above with the same symbol before it, their backward extensions are bounded at v + 1, and no later value can be
    less: so boundaries are set in breadth-first order of their values. After value ``least`` - 1 the rows that are
    still unbounded share ``least`` bytes.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    n, m = len(data), len(strings)
    if not n:
        return np.zeros(0, np.int64)
    lengths = np.array([len(s) for s in strings])
    stops = np.cumsum(lengths)
    ends = np.repeat(stops, lengths)
    order = suffix_array(data, ends)
    first = np.zeros(n, bool)
    first[(stops - lengths)[lengths > 0]] = True
    # The symbol before each suffix; string starts have none that could be extended.
    before = np.where(first[order], -1, data[np.maximum(order - 1, 0)].astype(np.int64))
    # Rows of the end marks: the symbol before a mark is its string's last byte.
    marks = np.where(lengths > 0, data[np.maximum(stops - 1, 0)].astype(np.int64), -1)
    transform = np.concatenate([marks, before])
    rows = len(transform)
    by = np.argsort(transform, kind="stable")
    by = by[transform[by] >= 0]
    symbol = transform[by]
    # Backward extension: rows with a symbol, in order, are the rows that begin with it.
    counts = np.bincount(data, minlength=256)
    begin = m + np.cumsum(counts) - counts
    target = begin[symbol] + (np.arange(len(by)) - (np.cumsum(counts) - counts)[symbol])
    above = np.empty(len(by), np.int64)
    above[0] = -1
    above[1:] = np.where(symbol[1:] == symbol[:-1], by[:-1], -1)
    bounded = np.zeros(rows + 1, bool)
    bounded[: m + 1] = True
    bounded[begin[counts > 0]] = True
    bounded[rows] = True
    alive = (above >= 0) & ~bounded[target]
    at, above, target = by[alive], above[alive], target[alive]
    set_so_far = np.cumsum(bounded)
    for _ in range(least - 1):
        if not len(at):
            break
        hit = set_so_far[at] > set_so_far[above]
        if not hit.any():
            break
        bounded[target[hit]] = True
        at, above, target = at[~hit], above[~hit], target[~hit]
        set_so_far = np.cumsum(bounded)
    group = np.cumsum(bounded[:-1])
    group[np.bincount(group)[group] < 2] = -1
    out = np.empty(n, np.int64)
    out[order] = group[m:]
    return out
