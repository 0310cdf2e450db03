"""Vectorised words, word hashes and shingles over the bytes of Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_TABLE = 1 << 16


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values; a bijection."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


mix = _splitmix
_PLACE = _splitmix(np.arange(_TABLE, dtype=_U) + _U(1 << 50)) | _U(1)

#: What bytes become: 0 separates words.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def byte_table(separators: bytes, fold: bool = True) -> np.ndarray:
    table = (FOLD if fold else np.arange(256, dtype=np.uint8)).copy()
    table[list(separators)] = 0
    return table


#: Words are runs without blank and 9-13; A-Z count as a-z.
SPACED = byte_table(bytes([32, *range(9, 14)]))
#: NUL is an ordinary byte of a word there, not the separator that 0 stands for; 255 occurs in no UTF-8 text.
SPACED[0] = 255
#: Words are runs of letters, digits and bytes beyond ASCII.
LETTERED = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def give_back() -> None:
    """Return a worker's free memory to the system; workers live on between tasks, and those of other stages need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(column: pa.Array, most_bytes: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row blocks of about ``most_bytes``: first row, bytes, and the n + 1 places where rows begin and end. Null is empty."""
    whole = column.cast(pa.large_binary())
    _, at, data = whole.buffers()
    if not len(whole):
        return
    offsets = np.frombuffer(at, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(whole):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        yield first, held[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Masks of the first 0 to 8 bytes of a word of eight, and the length beyond which a span is hashed by itself.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)
_ALONE = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: sums of the mixed eights of bytes, each with its number, and the length."""
    if not len(starts):
        return np.zeros(0, _U)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    total = lengths.astype(_U)
    with np.errstate(over="ignore"):
        at = np.flatnonzero((lengths > 0) & (lengths <= _ALONE))
        for k in range(_ALONE // 8):
            if not len(at):
                break
            here = eights[starts[at] + 8 * k] & _FIRST[np.minimum(lengths[at] - 8 * k, 8)]
            total[at] += _splitmix(here + _PLACE[k])
            at = at[lengths[at] > 8 * k + 8]
        for k in np.flatnonzero(lengths > _ALONE):
            a, n = int(starts[k]), int(lengths[k])
            here = eights[a : a + n : 8].astype(_U)
            here[-1] &= _FIRST[(n - 1) % 8 + 1]
            number = np.arange(len(here), dtype=_U)
            places = _PLACE[number] if len(here) <= _TABLE else _splitmix(number + _U(1 << 50)) | _U(1)
            total[k] += _splitmix(here + places).sum()
    return _splitmix(total)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its row, first byte, length and 64-bit hash."""
    folded = table[data]
    inside = folded != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, _U)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    lengths = np.flatnonzero(ends) - starts + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, starts, lengths, span_hashes(folded, starts, lengths)


def by_row_and_hash(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """The order by row, then hash: one sort of both in a word, and a plain one where its rest leaves ties open."""
    bits = _U(max(1, int(n_rows).bit_length()))
    joint = rows.astype(_U) << (_U(64) - bits) | hashes >> bits
    order = np.argsort(joint)
    joint = joint[order]
    same = np.flatnonzero(joint[1:] == joint[:-1])
    if len(same) and (hashes[order[same]] != hashes[order[same + 1]]).any():
        return np.lexsort((hashes, rows))
    return order


def shingles(rows: np.ndarray, hashes: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles as (row, hash) sorted by both; a row of fewer words has its whole sequence as one."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    left = ends[rows] - np.arange(len(rows))
    with np.errstate(over="ignore"):
        full = np.zeros(len(rows), _U)
        for j in range(k):
            fits = max(0, len(rows) - j)
            full[:fits] += hashes[j:] * _PLACE[1000 + j]
    keep = left >= k
    out_rows, out = rows[keep], _splitmix(full[keep])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        heads = ends[short] - counts[short]
        with np.errstate(over="ignore"):
            total = np.zeros(len(short), _U)
            for j in range(k - 1):
                has = counts[short] > j
                total[has] += hashes[heads[has] + j] * _PLACE[2000 + j]
            total += counts[short].astype(_U)
        out_rows, out = np.concatenate([out_rows, short]), np.concatenate([out, _splitmix(total)])
    order = by_row_and_hash(out_rows, out, n_rows)
    out_rows, out = out_rows[order], out[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (out_rows[1:] != out_rows[:-1])
    return out_rows[fresh], out[fresh]
