"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is that of their hashes. Equal sets are one node. For a pair of nodes over the threshold, sizes bound the
number of n-grams that only one of them has, d; cut the order into more than d fragments and some fragments of the two are
identical. Sizes fall into schemes: a node is cut by its own scheme, and by the one below where a partner may be in it, so that every
possible pair shares one. With m = d + 1 + e fragments, a linked pair shares at least 1 + e of them; up to e empty fragments of a node
are left out, and the number of others that it must share with someone is its need. Nodes that share fewer have no link.

Each fragment is joined by itself: the nodes that share it meet in a star, never pair by pair, around the node of their batch that shares most
fragments, and these around the one of all batches. Such a meeting is a partial overlap, the fragment's number of n-grams. Partial
overlaps are summed per pair; each node goes on with the partner it met most, and where the sum does not reach the threshold yet, the
overlaps of the other n-grams are counted for each of ``PARTS`` ranges of the order apart, and summed. Fragments with a meeting that is no link,
or went no further, are open if they hold several components. Their nodes of different components are joined by the first n-grams of each,
those that a sample finds in many nodes last, and by what the places of these allow; so no link between components is lost, while a group of
copies that drift apart, or texts that share a passage, form few pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import connected_components
from tallyforge.llm.shared import dropped, stored
from tallyforge.llm.textbytes import SPACED, give_back, mix, shingles, slices, words

#: Ranges of the global order whose overlaps are counted apart.
PARTS = 4
#: Rows that a task gathers before it sends them on, and the longs of the fixed-size filter of nodes (2 MB).
FLUSH, FILTER_LONGS = 250_000, 1 << 18
#: Of the nodes one in so many is looked at for n-grams that are frequent, and so many of these go to the end of the order. Any choice
#: gives the same links.
SAMPLED, FREQUENT = 64, 250_000
#: How much greater the largest size of a scheme is than its least.
WIDTH = 1.6
#: Bytes of a key that travel with its bucket; the bit of a weight that says that others stand behind the row.
_KEY_BYTES, _STANDS = 6, 1 << 15
_U = np.uint64


class Schemes:
    """Size classes and their numbers of fragments for the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.high, self.differ, self.spare = [], [], []

    def _grow(self, size: int) -> None:
        low = self.high[-1] + 1 if self.high else 1
        while low <= size or not self.high:
            high = max(low * self.den // self.num, int(low * WIDTH))
            # Both nodes are of this scheme, or the greater one is of the next.
            most = high + high * self.den // self.num
            d = most * (self.den - self.num) // (self.den + self.num)
            self.high.append(high)
            self.differ.append(d)
            # The more of these, the fewer nodes of common passages share as many fragments as a link needs.
            self.spare.append(2 + d // 5)
            low = high + 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The class of each size of at least 1."""
        self._grow(int(sizes.max()) if len(sizes) else 1)
        return np.searchsorted(np.array(self.high), sizes)

    def fragments(self, scheme: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fragments (0: only equal sets can be linked) and spare ones."""
        d, e = np.array(self.differ)[scheme], np.array(self.spare)[scheme]
        return np.where(d > 0, d + 1 + e, 0), e

    def reaches_below(self, sizes: np.ndarray, scheme: np.ndarray) -> np.ndarray:
        """Whether a smaller partner may be of the scheme below."""
        low = np.append(0, self.high)[scheme]
        return (scheme > 0) & (sizes * self.num <= low * self.den)


def node_ids(rows: np.ndarray, grams: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: a 64-bit id of its set of n-grams, and the set's size."""
    sizes = np.bincount(rows, minlength=n_rows)
    ids = np.zeros(n_rows, _U)
    with np.errstate(over="ignore"):
        if len(rows):
            heads = np.flatnonzero(np.diff(rows, prepend=-1))
            ids[rows[heads]] = np.add.reduceat(mix(grams ^ _U(0xA5A5A5A5)), heads)
        ids = mix(ids + sizes.astype(_U))
    return ids.view(np.int64), sizes


def fragment_keys(rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, part, need) of the fragments; part is twice the number of n-grams (127 at most), and 1 more in odd schemes."""
    out = []
    own = np.zeros(len(sizes), np.int64)
    own[sizes > 0] = schemes.of(sizes[sizes > 0])
    for below in (0, 1):
        scheme = own - below
        valid = sizes > 0 if not below else (sizes > 0) & schemes.reaches_below(sizes, own)
        count, spare = schemes.fragments(np.where(valid, scheme, 0))
        count = np.where(valid, count, 0)
        use = count[rows] > 0
        r, g = rows[use], grams[use]
        if not len(r):
            continue
        place = ((g >> _U(32)) * count[r].astype(_U)) >> _U(32)
        head = np.ones(len(r), bool)
        head[1:] = (r[1:] != r[:-1]) | (place[1:] != place[:-1])
        heads = np.flatnonzero(head)
        fr = r[heads]
        odd = (scheme[fr] & 1).astype(np.uint8)
        with np.errstate(over="ignore"):
            where = mix(place[heads] + (scheme[fr].astype(_U) << _U(32)))
            keys = mix(np.add.reduceat(mix(g), heads) ^ where)
        n = np.diff(np.append(heads, len(r)))
        empty = count - np.bincount(fr, minlength=len(sizes))
        need = np.clip(1 + spare - empty, 1, 255).astype(np.uint8)
        out.append((fr, keys, (np.minimum(n, 127) << 1).astype(np.uint8) | odd, need[fr]))
        for row in np.flatnonzero((empty > spare) & (count > 0)):
            gone = np.setdiff1d(np.arange(count[row], dtype=_U), place[heads][fr == row])
            out.append((np.full(len(gone), row), mix(mix(gone + (_U(scheme[row]) << _U(32)))), np.full(len(gone), scheme[row] & 1, np.uint8), np.ones(len(gone), np.uint8)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*out))


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, data, offsets in slices(column):
        n = len(offsets) - 1
        rows, _, _, hashes = words(data, offsets, SPACED)
        yield first, n, *shingles(rows, hashes, k, n)


def _leaders(ids: np.ndarray, weight: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, of its group: the id of greatest weight (ties: the least), and how many rows it has. Groups begin at ``heads``."""
    count = np.diff(np.append(heads, len(ids)))
    most = np.repeat(np.maximum.reduceat(weight, heads), count)
    held = np.where(weight == most, ids, np.iinfo(np.int64).max)
    return np.repeat(np.minimum.reduceat(held, heads), count), np.repeat(count, count)


def _pack_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].tobytes()


def _unpack_keys(packed: pa.Buffer) -> np.ndarray:
    short = np.frombuffer(packed, np.uint8).reshape(-1, _KEY_BYTES)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :_KEY_BYTES] = short
    return out.view("<u8").ravel()


_BLOBS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("parts", pa.binary()), ("needs", pa.binary()), ("weights", pa.binary()), ("leaders", pa.binary())])


def fragment_members(docs: DataFrame, k: int, num: int, den: int, *, text_col: str = "text") -> DataFrame:
    """``key, id, leader, part, need``: for every fragment that two nodes share, all its nodes, each with the one it meets."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions

    def flushed(held: list[tuple], turn: int) -> pa.RecordBatch:
        keys, ids, parts, needs = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(keys, kind="stable")
        keys, ids, parts, needs = keys[order], ids[order], parts[order], needs[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(heads, len(keys)))
        shared = np.repeat(count > 1, count)
        # How many fragments a node shares in the batch: the node that copies have drifted from shares most.
        _, at = np.unique(ids, return_inverse=True)
        weight = np.minimum(np.bincount(at, shared), _STANDS - 1).astype(np.uint16)[at]
        leaders, count = _leaders(ids, weight, heads)
        # Of each key one node goes on, and says if it stands for others. The others need no grouping, so they are dealt out evenly.
        on = ids == leaders
        weight = weight | np.where(count > 1, _STANDS, 0).astype(np.uint16)
        bucket = ((keys >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
        edges = np.searchsorted(bucket[on], np.arange(buckets + 1))
        cols = [x[on] for x in (keys, ids, parts, needs, weight)]
        rows = [(b, _pack_keys(cols[0][x:y]), *(c[x:y].tobytes() for c in cols[1:]), None) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
        rest = np.flatnonzero(~on)
        for n, some in enumerate(np.array_split(rest, len(rest) // 20_000 + 1)):
            if len(some):
                to = int(mix(keys[some[:1]] + _U(turn + n))[0] % _U(buckets))
                rows.append((to, _pack_keys(keys[some]), ids[some].tobytes(), parts[some].tobytes(), needs[some].tobytes(), b"", leaders[some].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOBS)], schema=_BLOBS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, held, size, turn = Schemes(num, den), [], 0, 0
        # A node's copies leave a task once.
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for _, n, rows, grams in _sets(batch.column(0), k):
                ids, sizes = node_ids(rows, grams, n)
                first = np.zeros(n, bool)
                first[np.unique(ids, return_index=True)[1]] = True
                first &= (sizes > 0) & ~np.isin(ids, seen)
                seen = np.append(seen, ids[first])
                wanted = first[rows]
                r, keys, parts, needs = fragment_keys(rows[wanted], grams[wanted], np.where(first, sizes, 0), schemes)
                if len(r):
                    held.append((keys, ids[r], parts, needs))
                    size += len(r)
                if size >= FLUSH:
                    yield flushed(held, turn)
                    size, turn = 0, turn + 1000
        if held:
            yield flushed(held, turn)
        give_back()

    def out(keys: np.ndarray, ids: np.ndarray, leaders: np.ndarray, parts: np.ndarray, needs: np.ndarray) -> pa.RecordBatch:
        cols = [keys.view(np.int64), ids, leaders, parts.astype(np.int16), needs.astype(np.int16)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id", "leader", "part", "need"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def done() -> Iterator[pa.RecordBatch]:
            keys, ids, parts, needs, weight = (np.concatenate(x) for x in zip(*held))
            held.clear()
            stands = weight >= _STANDS
            weight = weight & (_STANDS - 1)
            # Tasks may weigh one node differently; its greatest weight counts.
            order = np.lexsort((-weight.astype(np.int32), ids, keys))
            keys, ids, parts, needs, weight, stands = (x[order] for x in (keys, ids, parts, needs, weight, stands))
            head = np.append(True, keys[1:] != keys[:-1])
            some_stand = np.maximum.reduceat(stands, np.flatnonzero(head))
            once = head | np.append(True, ids[1:] != ids[:-1])
            keys, ids, parts, needs, weight, head = (x[once] for x in (keys, ids, parts, needs, weight, head))
            leaders, count = _leaders(ids, weight, np.flatnonzero(head))
            # A key's leader is a row of its own, if there are others.
            others = (count > 1) | some_stand[np.cumsum(head) - 1]
            if others.any():
                yield out(keys[others], ids[others], leaders[others], parts[others], needs[others])

        for batch in batches:
            for row in range(len(batch)):
                bucket, keys, ids, parts, needs, weights, leaders = (batch.column(c)[row] for c in range(7))
                keys = _unpack_keys(keys.as_buffer())
                ids, parts, needs = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(parts.as_buffer(), np.uint8), np.frombuffer(needs.as_buffer(), np.uint8)
                if leaders.is_valid:
                    yield out(keys, ids, np.frombuffer(leaders.as_buffer(), np.int64), parts, needs)
                    continue
                if bucket.as_py() != now and held:
                    yield from done()
                now = bucket.as_py()
                held.append((keys, ids.copy(), parts.copy(), needs.copy(), np.frombuffer(weights.as_buffer(), np.uint16).copy()))
        if held:
            yield from done()
        give_back()

    blobs = docs.select(text_col).mapInArrow(cut, "bucket int, keys binary, ids binary, parts binary, needs binary, weights binary, leaders binary")
    return blobs.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(join, "key long, id long, leader long, part short, need short")


def _filter_of(nodes: DataFrame, column: str = "id") -> np.ndarray:
    """A filter of fixed size: the bits of a column's longs modulo its length. It lets through what is not there, never the reverse."""
    bit = F.pmod(column, F.lit(FILTER_LONGS * 64))
    longs = nodes.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("long"))
    got = longs.toArrow()
    out = np.zeros(FILTER_LONGS, np.int64)
    out[got.column("at").to_numpy()] = got.column("long").to_numpy()
    return out


def node_sets(docs: DataFrame, nodes: DataFrame, k: int, *, text_col: str = "text") -> DataFrame:
    """``id, size, grams``: the sorted n-grams of each node, for each range of the global order."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_filter_of(nodes))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, np.zeros(0, np.int64)
        for batch in batches:
            for _, n, rows, grams in _sets(batch.column(0), k):
                ids, sizes = node_ids(rows, grams, n)
                place = ids % (FILTER_LONGS * 64)
                first = np.zeros(n, bool)
                first[np.unique(ids, return_index=True)[1]] = True
                wanted = first & (sizes > 0) & ((bits[place >> 6] >> (place & 63)) & 1 > 0) & ~np.isin(ids, seen)
                seen = np.append(seen, ids[wanted])
                edges = np.searchsorted(rows, np.arange(n + 1))
                out = []
                for row in np.flatnonzero(wanted):
                    mine = grams[edges[row] : edges[row + 1]]
                    cuts = np.searchsorted(mine, np.arange(PARTS, dtype=_U) << _U(62))
                    out.append((ids[row], sizes[row], [mine[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(mine)])]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.list_(pa.binary())))], ["id", "size", "grams"])
        give_back()

    found = docs.select(text_col).mapInArrow(sets, "id long, size int, grams array<binary>")
    return found.groupBy("id").agg(F.first("size").alias("size"), F.first("grams").alias("grams")).join(nodes, "id", "left_semi")


def links(pairs: DataFrame, sets: DataFrame, num: int, den: int, scratch: list[DataFrame]) -> DataFrame:
    """Those ``a, b`` of ``pairs`` with den * intersection >= num * union: partial overlaps per range, summed per pair.

    Pairs whose ``met``, the sum of their meetings' overlaps, reaches that already are links as they are."""

    def count(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in columns:
            out = []
            for a, b in zip(left, right):
                a, b = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
                both = np.sort(np.concatenate([a, b]))
                out.append(int((both[1:] == both[:-1]).sum()))
            yield pa.array(out, pa.int64())

    count = F.arrow_udf(count, "long")
    size = lambda c: sets.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"))
    side = lambda c: sets.select(F.col("id").alias(c), F.posexplode("grams").alias("part", f"grams_{c}"))
    enough = lambda shared: F.col(shared) * den >= (F.col("size_a") + F.col("size_b") - F.col(shared)) * num
    near = (F.col("size_a") * den >= F.col("size_b") * num) & (F.col("size_b") * den >= F.col("size_a") * num)
    sized = stored(pairs.join(size("a"), "a").join(size("b"), "b").where(near), "sized", scratch)
    parts = sized.where(~enough("met")).select("a", "b", "size_a", "size_b", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    both = parts.join(side("a"), ["a", "part"]).where(F.octet_length("grams_a") >= 0).join(side("b"), ["b", "part"])
    partial = both.select("a", "b", "size_a", "size_b", count("grams_a", "grams_b").alias("shared"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    return total.where(enough("shared")).select("a", "b").unionByName(sized.where(enough("met")).select("a", "b"))


def with_enough(members: DataFrame) -> DataFrame:
    """``id``: nodes that have as many of ``members`` (distinct key, id, with part and need), in one scheme, as a link needs."""
    counts = members.groupBy("id", (F.col("part") % 2).alias("odd")).agg(F.count("*").alias("n"), F.max("need").alias("need"))
    return counts.where("n >= need").select("id").distinct()


def open_nodes(members: DataFrame, linked: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, label``: nodes with as many fragments that hold several components as a link needs, and their component."""
    pair = members.where("id <> leader").select("key", F.col("id").alias("a"), F.col("leader").alias("b"))
    open_keys = pair.join(linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti").select("key").distinct()
    rows = members.groupBy("key", "id").agg(F.max("part").alias("part"), F.min("need").alias("need")).join(open_keys, "key", "left_semi")
    rows = rows.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    spread = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    counts = rows.join(spread, "key", "left_semi").groupBy("id", (F.col("part") % 2).alias("odd")).agg(F.count("*").alias("n"), F.max("need").alias("need"), F.first("label").alias("label"))
    return counts.where("n >= need").select("id", "label").distinct()


def cross_pairs(nodes: DataFrame, sets: DataFrame, num: int, den: int, scratch: list[DataFrame]) -> DataFrame:
    """``a, b``: pairs of different components among ``nodes`` (id, label) that may be links.

    In any one order of the n-grams, linked sets share one of each other's first size - ceil(size * num / den) + 1, and from the places of
    the one shared first follows how many they can share at most. Here the order is that of the hashes, but n-grams which a sample of the nodes
    finds frequent come last.
    """
    spark = nodes.sparkSession

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(grams.as_py()), np.int64))], ["gram"])

    some = sets.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("grams").mapInArrow(spelled, "gram long")
    frequent = some.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "gram").limit(FREQUENT)
    shared = spark.sparkContext.broadcast(_filter_of(frequent, "gram"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, names = shared.value, ["gram", "place", "id", "label", "size"]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                grams, places, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
                for row, (size, mine) in enumerate(zip(part.column("size").to_pylist(), part.column("grams"))):
                    mine = np.frombuffer(b"".join(mine.as_py()), np.int64)
                    place = mine % (FILTER_LONGS * 64)
                    late = (bits[place >> 6] >> (place & 63)) & 1 > 0
                    most = size - -(-size * num // den) + 1
                    grams.append(np.concatenate([mine[~late], mine[late]])[:most])
                    places.append(np.arange(most, dtype=np.int32))
                    rows.append(np.full(most, row))
                taken = part.select(["id", "label", "size"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(places)), *taken.columns], names)
        give_back()

    index = stored(sets.join(nodes, "id").select("id", "label", "size", "grams").mapInArrow(first, "gram long, place int, id long, label long, size int"), "index", scratch)
    # N-grams of one node alone go before the rows are joined.
    common = index.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("gram")
    index = stored(index.join(common, "gram", "left_semi"), "index", scratch)
    left, right = (index.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "size", "label", "place")]) for side in "ab")
    most = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    may = most * (num + den) >= (F.col("size_a") + F.col("size_b")) * num
    both = left.join(right, (left["gram"] == right["gram"]) & F.expr("id_a < id_b AND label_a <> label_b") & may)
    return both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def node_table(docs: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, node, n_shingles`` per row."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, rows, grams in _sets(batch.column(1), k):
                ids, sizes = node_ids(rows, grams, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(ids), pa.array(sizes, pa.int64())], ["id", "node", "n_shingles"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(nodes, "id long, node long, n_shingles long").withColumnRenamed("id", id_col)


def node_labels(docs: DataFrame, k: int, num: int, den: int, *, text_col: str = "text") -> DataFrame:
    """``node, label``: the component of every node that has a link."""
    scratch: list[DataFrame] = []
    members = stored(fragment_members(docs, k, num, den, text_col=text_col), "members")
    # What a pair met with in the fragments of one scheme is a part of its overlap.
    odd = F.col("part") % 2 == 1
    grams = F.col("part").cast("int").bitwiseAND(254) / 2
    met = F.greatest(F.sum(F.when(odd, grams).otherwise(0)), F.sum(F.when(odd, 0).otherwise(grams))).cast("long")
    pairs = members.where("id <> leader").groupBy(F.col("id").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("n"), met.alias("met"))
    # Each node goes on with the one it shares most fragments with.
    best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "b", "met")).alias("best"))
    stars = stored(best.select("a", "best.b", "best.met"), "stars", scratch)
    able = stored(with_enough(members.groupBy("key", "id").agg(F.max("part").alias("part"), F.min("need").alias("need"))), "able", scratch)
    sets = stored(node_sets(docs, able, k, text_col=text_col), "sets", scratch)
    linked = stored(links(stars, sets, num, den, scratch), "links", scratch)
    labels = stored(connected_components(linked, scratch), "labels")
    opened = stored(open_nodes(members.join(able, "id", "left_semi"), linked, labels), "open", scratch)
    dropped(members)
    if not opened.isEmpty():
        more = cross_pairs(opened, sets, num, den, scratch)
        known = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = stored(links(more.join(known, ["a", "b"], "left_anti").withColumn("met", F.lit(0)), sets, num, den, scratch), "links", scratch)
        if not found.isEmpty():
            first, labels = labels, stored(connected_components(linked.unionByName(found), scratch), "labels")
            dropped(first)
    dropped(*scratch)
    return labels


def keyed_nodes(rows: DataFrame, k: int) -> DataFrame:
    """``id, key, node, n_shingles`` per row of ``id, key, text``."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, rows, grams in _sets(batch.column(2), k):
                ids, sizes = node_ids(rows, grams, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(ids), pa.array(sizes, pa.int64())], ["id", "key", "node", "n_shingles"])

    return rows.select("id", "key", "text").mapInArrow(nodes, "id long, key long, node long, n_shingles long")


def near_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col, n_shingles, component_id``: the smallest id reachable by links of Jaccard similarity >= num / den.

    N-grams are ``k`` words (runs without blank and 9-13; A-Z as a-z); a shorter text is one n-gram as a whole, a text without words has none and
    is linked with nothing. Null text counts as empty. Repeated rows and ids are rows of their own. Null ids are
    linked like others, but never a component's smallest id, unless it has no other. An empty table gives an empty result.
    N-grams and sets are told apart by 64-bit hashes.
    """
    labels = node_labels(docs, k, num, den, text_col=text_col)
    table = stored(node_table(docs, k, id_col=id_col, text_col=text_col), "nodes")
    full = table.where("n_shingles > 0").join(labels, "node", "left").select(id_col, "n_shingles", F.coalesce("label", "node").alias("label"))
    # Written first, so that the join's two sides are plain and a component of very many rows can be split.
    least = stored(full.groupBy("label").agg(F.min(id_col).alias("component_id")), "least")
    empty = table.where("n_shingles = 0").select(id_col, "n_shingles", F.col(id_col).alias("component_id"))
    return full.join(least, "label").select(id_col, "n_shingles", "component_id").unionByName(empty)


def _without(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows of these ids and keys."""
    named = rows.toDF("_id", "_key")
    return docs.join(named, (docs[id_col] == named["_id"]) & (F.xxhash64(docs[text_col]) == named["_key"]), "left_anti")


def one_of_each(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, one of the smallest id; all columns as they were.

    Rows are told by id and text, so rows of one id in different components are judged each on its own. Rows without words, and rows without
    id, are compared with nothing and stay. Of rows that repeat the chosen id within their component one stays. Texts are told apart by 64-bit hashes.
    """
    named = docs.where(F.col(id_col).isNotNull())
    labels = node_labels(named, k, num, den, text_col=text_col)
    keyed = named.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    table = stored(keyed_nodes(keyed, k).where("n_shingles > 0").join(labels, "node", "left").select("id", "key", F.coalesce("label", "node").alias("label")), "nodes")
    least = stored(table.groupBy("label").agg(F.min("id").alias("least")), "least")
    judged = table.join(least, "label")
    chosen = judged.where("id = least")
    # Components whose smallest id has several rows; that with the smallest key stays.
    several = stored(chosen.groupBy("label").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1").select("label", "first"), "repeated")
    gone = judged.where("id <> least").select("id", "key")
    if several.isEmpty():
        gone = stored(gone.distinct(), "gone")
        dropped(labels, table, least, several)
        return _without(docs, gone, id_col, text_col)
    again = chosen.join(several, "label")
    gone = stored(gone.unionByName(again.where("key <> first").select("id", "key")).distinct(), "gone")
    repeated = stored(again.where("key = first").select("id", "key").distinct(), "kept")
    dropped(labels, table, least, several)
    rest = _without(docs, gone, id_col, text_col)
    named = repeated.toDF("_id", "_key")
    once = rest.join(named, (rest[id_col] == named["_id"]) & (F.xxhash64(rest[text_col]) == named["_key"]), "left_semi").dropDuplicates([id_col, text_col])
    return _without(rest, repeated, id_col, text_col).unionByName(once)
