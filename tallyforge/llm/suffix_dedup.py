"""Removal of every byte covered by a string of ``least`` bytes that starts elsewhere as well, over all documents.

A Burrows-Wheeler transform is built for bounded batches of text (``bwt``), in which threshold-bounded interval expansion finds the
repeated strings. What has to meet in a batch is found by anchors: of each ``least`` bytes, the pieces of ``PIECE`` bytes whose hash is
smallest (the leftmost of equal ones). Each string has one anchor, and equal strings have equal anchors at equal places, so an anchor that occurs
once rules out its strings. An anchor's context is what its strings cover: contexts that occur more than once are repeated as a
whole; those that occur once, but share their anchor with others, are compared, together with one of each of the others: in a batch,
``SIEVE_BITS`` of the strings' hashes rule out most of those that are alone, and the transform tells the repeats in what is left. The contexts of an
anchor beyond ``BLOCK`` go to several batches; strings that two of these may share meet in a further transform.

Documents are told apart by the hash and length of their text, so copies are worked on once; anchors and contexts by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bwt import repeat_groups
from tallyforge.llm.shared import dropped, stored
from tallyforge.llm.textbytes import give_back, mix, slices

LEAST, PIECE = 200, 64
#: Distinct contexts of an anchor in one batch; bytes in a batch; longs of the fixed-size filters (4 MB).
BLOCK, BATCH_BYTES, FILTER_LONGS = 2048, 1 << 20, 1 << 19
#: Bits of the hashes that rule out strings which are alone in a batch; what shares them by chance is told apart by the transform.
SIEVE_BITS = 28
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(256, dtype=_U) + _U(77)) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept per worker."""
    if len(_powers.get("base", ())) <= n:
        size = 1 << max(19, int(n).bit_length())
        for name, x in (("base", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, x, _U)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(out, dtype=_U)
    return _powers["base"], _powers["inverse"]


class Hashes:
    """Hashes of any substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        base, self.inverse = _power(len(data))
        self.sums = np.zeros(len(data) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * base[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    pad = (-len(x)) % width
    blocks = np.append(x, np.full(pad, np.iinfo(_U).max, _U)).reshape(-1, width)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _leftmost(x: np.ndarray, lowest: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each ``width`` neighbours stands, the leftmost of equal ones; ``lowest`` are these values."""
    n = len(lowest)
    place = np.zeros(n, np.int64)
    # A value below all before has just come in at the right.
    falls = np.flatnonzero(lowest[1:] < lowest[:-1]) + 1
    place[falls] = falls + width - 1
    # Where the place before has been left, the next one is looked up; elsewhere it stays, and places only grow.
    left = np.flatnonzero(np.append(True, (lowest[1:] > lowest[:-1]) | (x[: n - 1] == lowest[1:])))
    windows = np.lib.stride_tricks.sliding_window_view(x, width)
    for a in range(0, len(left), 1024):
        some = left[a : a + 1024]
        place[some] = some + (windows[some] == lowest[some, None]).argmax(axis=1)
    return np.maximum.accumulate(place)


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: document, place, hash of its piece, and the first and last start of the strings it stands for. Places are in ``data``.

    Every string has one anchor, so the runs of starts are disjoint."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none.view(_U), none, none
    hashes = Hashes(data)
    at = np.arange(len(data) - PIECE + 1)
    pieces = mix(hashes.of(at, at + PIECE))
    width = least - PIECE + 1
    low = _leftmost(pieces, _sliding_min(pieces, width), width)
    row = np.searchsorted(offsets, np.arange(len(low)), "right") - 1
    starts = np.flatnonzero(np.arange(len(low)) + least <= offsets[row + 1])
    if not len(starts):
        return none, none, none.view(_U), none, none
    chosen, row = low[starts], row[starts]
    head = np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(starts)) - 1
    return row[first], chosen[first], pieces[chosen[first]], starts[first], starts[last]


def text_keys(text):
    """Columns that tell texts apart."""
    return F.xxhash64(text).alias("t"), F.octet_length(text).alias("n")


def _bits(df: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size over a column of longs; it lets others through now and then, never the reverse."""
    bit = F.pmod(column, F.lit(FILTER_LONGS * 64))
    got = df.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("long")).toArrow()
    out = np.zeros(FILTER_LONGS, np.int64)
    out[got.column("at").to_numpy()] = got.column("long").to_numpy()
    return out


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.view(np.int64) % (FILTER_LONGS * 64)
    return (bits[place >> 6] >> (place & 63)) & 1 > 0


def anchor_counts(texts: DataFrame, least: int) -> DataFrame:
    """``anchor``: those that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(data, offsets, least)[2] for _, data, offsets in slices(batch.column(0))]
            value, n = np.unique(np.concatenate([np.zeros(0, _U), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["anchor", "times"])

    return texts.select("text").mapInArrow(count, "anchor long, times long").groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")


def occurrences(texts: DataFrame, repeated: DataFrame, least: int) -> DataFrame:
    """``anchor, context, t, n, first, last, times``: the runs of starts of repeated anchors; times counts equal texts of a batch."""
    bits = texts.sparkSession.sparkContext.broadcast(_bits(repeated, "anchor"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = batch.column("t").to_numpy(), batch.column("n").to_numpy()
            _, first, times = np.unique(np.stack([t, n]), axis=1, return_index=True, return_counts=True)
            copies = np.zeros(len(t), np.int64)
            copies[first] = times
            for start, data, offsets in slices(batch.column("text")):
                row, place, anchor, first, last = anchors(data, offsets, least)
                keep = _passes(bits.value, anchor) & (copies[row + start] > 0)
                if not keep.any():
                    continue
                row, place, anchor, first, last = (x[keep] for x in (row, place, anchor, first, last))
                shape = mix(((place - first + least).astype(_U) << _U(32)) + (last - first).astype(_U))
                context = mix(Hashes(data).of(first, last + least) ^ shape)
                base = offsets[row]
                row = row + start
                cols = [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(t[row]), pa.array(n[row]), pa.array(first - base, pa.int32()), pa.array(last - base, pa.int32()), pa.array(copies[row], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "context", "t", "n", "first", "last", "times"])

    found = texts.select("t", "n", "text").mapInArrow(places, "anchor long, context long, t long, n int, first int, last int, times int")
    return found.join(repeated, "anchor", "left_semi")


def contexts(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``wanted`` (anchor, salt, salts, times, t, n, first, last) with the ``bytes`` of its strings."""
    spark = texts.sparkSession
    per_text = wanted.groupBy("t", "n").agg(F.collect_list(F.struct("anchor", "salt", "salts", "times", "first", "last")).alias("places"))
    bits = spark.sparkContext.broadcast(_bits(wanted, "t"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t").to_numpy()
            keep = _passes(bits.value, t)
            _, first = np.unique(t, return_index=True)
            once = np.zeros(len(t), bool)
            once[first] = True
            yield batch.filter(pa.array(keep & once))

    rows = texts.select("t", "n", "text").mapInArrow(candidates, "t long, n int, text string")
    # Copies that other batches hold are dropped here; a hot text leaves each batch once.
    rows = rows.groupBy("t", "n").agg(F.first("text").alias("text")).join(per_text, ["t", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 64):
                out = []
                for t, n, text, places in zip(*(batch.column(c).slice(part, 64) for c in ("t", "n", "text", "places"))):
                    data = text.as_py().encode()
                    for p in places.as_py():
                        out.append((p["anchor"], p["salt"], p["salts"], p["times"], t.as_py(), n.as_py(), p["first"], data[p["first"] : p["last"] + least]))
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], ["anchor", "salt", "salts", "times", "t", "n", "first", "bytes"])

    return rows.mapInArrow(cut, "anchor long, salt int, salts int, times long, t long, n int, first int, bytes binary")


_FOUND = pa.schema([("kind", pa.int32()), ("t", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("string", pa.int64()), ("anchor", pa.int64())])


def compare(rows: DataFrame, least: int) -> DataFrame:
    """Runs of repeated starts in contexts that occur once (kind 0: t, n, first, last), and, of anchors with several batches, the hashes of
    all distinct strings of a batch (kind 1), with their place where it is not known yet whether they are repeated (kind 2)."""

    def batch_out(held: list[tuple]) -> pa.RecordBatch | None:
        """Hashes of all strings rule out those that are alone in the batch. What is left of the contexts, each distinct piece once, is
        transformed."""
        lengths = np.array([len(h[7]) for h in held])
        stops = np.cumsum(lengths)
        data = np.frombuffer(b"".join(h[7] for h in held), np.uint8)
        runs = lengths - least + 1
        owner = np.repeat(np.arange(len(held)), runs)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = (stops - lengths)[owner] + within
        hashes = Hashes(data).of(at, at + least).view(np.int64)
        single = np.array([h[3] < 2 for h in held])
        times = np.where(single, 1, 2)[owner]
        _, same = np.unique(mix(hashes.view(_U)) >> _U(64 - SIEVE_BITS), return_inverse=True)
        likely = np.bincount(same, times)[same] > 1
        edge = np.append(True, (likely[1:] != likely[:-1]) | (owner[1:] != owner[:-1]))
        heads = np.flatnonzero(edge)
        tails = np.append(heads[1:], len(owner)) - 1
        heads, tails = heads[likely[heads]], tails[likely[heads]]
        pieces: dict[bytes, int] = {}
        number = [pieces.setdefault(data[at[a] : at[b] + least].tobytes(), len(pieces)) for a, b in zip(heads, tails)]
        often = np.bincount(number, times[heads], minlength=len(pieces)) > 1 if number else np.zeros(0, bool)
        strings = list(pieces)
        shared = repeat_groups(strings, least) >= 0
        begin = np.append(0, np.cumsum([len(x) for x in strings])).astype(np.int64)
        flags = np.zeros(len(owner), bool)
        for a, b, k in zip(heads, tails, number):
            flags[a : b + 1] = True if often[k] else shared[begin[k] : begin[k] + b - a + 1]
        info = {k: np.array([h[i] for h in held]) for k, i in (("anchor", 0), ("salts", 2), ("t", 4), ("n", 5), ("first", 6))}
        hit = flags & single[owner]
        edge = np.append(True, (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1]))
        heads = np.flatnonzero(edge)
        tails = np.append(heads[1:], len(owner)) - 1
        heads, tails = heads[hit[heads]], tails[hit[heads]]
        cols = [np.zeros(len(heads), np.int32), info["t"][owner[heads]], info["n"][owner[heads]], info["first"][owner[heads]] + within[heads], info["first"][owner[heads]] + within[tails], np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)]
        several = np.flatnonzero(info["salts"][owner] > 1)
        if len(several):
            # Each known repeat once, and every string that is none here.
            known = (flags | ~single[owner])[several]
            one = np.unique(np.stack([info["anchor"][owner[several]], hashes[several]]), axis=1, return_index=True)[1]
            keep = ~known
            keep[one] = True
            x, known = several[keep], known[keep]
            place = info["first"][owner[x]] + within[x]
            more = [np.where(known, 1, 2), info["t"][owner[x]], info["n"][owner[x]], place, place, hashes[x], info["anchor"][owner[x]]]
            cols = [np.concatenate(c) for c in zip(cols, more)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND)], schema=_FOUND) if len(cols[0]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "salt", "salts", "times", "t", "n", "first", "bytes"))):
                if row[:2] != now and size >= BATCH_BYTES:
                    if (got := batch_out(held)) is not None:
                        yield got
                    held, size = [], 0
                now = row[:2]
                held.append(row)
                size += len(row[7])
        if held and (got := batch_out(held)) is not None:
            yield got
        give_back()

    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.mapInArrow(run, "kind int, t long, n int, first int, last int, string long, anchor long")


def repeated_runs(texts: DataFrame, least: int, scratch: list[DataFrame]) -> DataFrame:
    """``t, n, first, last``: runs of repeated starts; runs of one text may overlap."""
    repeated = stored(anchor_counts(texts, least), "anchors", scratch)
    found = stored(occurrences(texts, repeated, least), "places", scratch)
    kinds = found.groupBy("anchor", "context").agg(F.sum("times").alias("times"), F.min(F.struct("t", "n", "first", "last")).alias("one"))
    kinds = stored(kinds, "contexts", scratch)
    whole = found.join(kinds.where("times > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("t", "n", "first", "last")
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("n_contexts"), F.min("times").alias("least_times")).where("n_contexts > 1 AND least_times = 1")
    salts = F.ceil(F.col("n_contexts") / BLOCK).cast("int")
    wanted = kinds.join(groups, "anchor").withColumn("salts", salts).select("anchor", F.pmod(F.xxhash64("context"), F.col("salts")).cast("int").alias("salt"), "salts", "times", "one.t", "one.n", "one.first", "one.last")
    compared = stored(compare(contexts(texts, stored(wanted, "wanted", scratch), least), least), "compared", scratch)
    runs = whole.unionByName(compared.where("kind = 0").select("t", "n", "first", "last"))
    # Strings of one anchor in several batches: hashes rule out those that one batch alone has, and of the others one that is known to be
    # repeated, or any, and another one meet in a further transform.
    across = compared.where("kind > 0")
    if not across.isEmpty():
        origin = F.struct("t", "n", "first")
        known, unknown = F.when(F.col("kind") == 1, origin), F.when(F.col("kind") == 2, origin)
        same = across.groupBy("anchor", "string").agg(F.min(known).alias("known"), F.min(unknown).alias("one"), F.max(unknown).alias("other"))
        same = same.where("one IS NOT NULL AND (known IS NOT NULL OR one <> other)")
        met = stored(same.select("anchor", "string", F.explode(F.array("one", F.coalesce("known", "other"))).alias("o")).select("anchor", "string", "o.*"), "met", scratch)
        once = F.lit(1).cast("long")
        again = met.select(F.xxhash64("anchor", "string").alias("anchor"), F.lit(0).alias("salt"), F.lit(1).alias("salts"), once.alias("times"), "t", "n", "first", F.col("first").alias("last"))
        equal = stored(compare(contexts(texts, again, least), least), "equal", scratch)
        sure = met.join(equal.select("t", "n", "first"), ["t", "n", "first"], "left_semi").select("anchor", "string").distinct()
        runs = runs.unionByName(across.where("kind = 2").join(sure, ["anchor", "string"], "left_semi").select("t", "n", "first", "last"))
    return runs


def removed_spans(first: np.ndarray, last: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by strings of ``least`` bytes that start in the runs."""
    out: list[list[int]] = []
    for k in np.argsort(first, kind="stable"):
        a, b = int(first[k]), int(last[k]) + least
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col, n_bytes, spans`` (removed, as [start, end) bytes) and ``kept`` (the remaining bytes).

    Null text is empty. Every row is a document of its own, so repeated rows of at least ``least`` bytes lose all of their bytes; null and
    repeated ids stay as they are. Shorter texts lose nothing. Strings never cross documents. An empty table gives an empty
    result; other columns are ignored.
    """
    if least < 2 * PIECE:
        raise ValueError(f"least must be {2 * PIECE} or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), *text_keys(text))
    scratch: list[DataFrame] = []
    runs = stored(repeated_runs(texts.where(F.col("n") >= least), least, scratch), "runs")
    dropped(*scratch)
    # Distinct runs of a text are bounded by its length.
    per_text = runs.groupBy("t", "n", "first").agg(F.max("last").alias("last")).groupBy("t", "n").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = texts.join(per_text, ["t", "n"], "left")
    types = [("id", joined.schema["id"].dataType.simpleString()), ("n_bytes", "long"), ("spans", "array<struct<start:int,end:int>>"), ("kept", "binary")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                data = text.as_py().encode()
                mine = []
                if runs.is_valid and len(runs):
                    at = runs.values
                    mine = removed_spans(at.field("first").to_numpy(), at.field("last").to_numpy(), least)
                edges = [0, *(x for s in mine for x in s), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if mine else data)
                spans.append([{"start": a, "end": b} for a, b in mine])
                sizes.append(len(data))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    out = joined.select("id", "text", "runs").mapInArrow(keep, ", ".join(f"{a} {b}" for a, b in types))
    return out.withColumnRenamed("id", id_col)


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the remaining bytes' SHA-256, from ``remove_repeats``."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select(id_col, "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

