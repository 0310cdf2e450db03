"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers by their length: whole windows of the longest tier are cut off first, and what is
left goes to the shortest tier that holds it. Each tier packs its documents into windows of exactly its size, longest documents
first; a gap that the next document would overrun is filled with documents of shorter tiers (the longest that fits), and only
then is a document cut. At the end of a task the open windows of all tiers are put together, longest window first, and the last
tokens are cut at powers of two, so that no padding is left. Full windows are dealt out to step groups of equal token count,
balanced by attention cost (the sum of squared piece lengths).

Every task packs what it reads, batch by batch: no shuffle, and memory is bounded by a batch and the open windows. A task that is
run again reads the same rows and packs them alike.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.encoding import ChunkEncoder, TokenizerFile

SCHEMA = pa.schema(
    [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]
)
#: Bits of a sequence or step number below the partition's number.
LOCAL_BITS = 36


class Piece:
    """Ids of one document from ``start`` on, not yet cut to their final length."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: memoryview, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class TierPacker:
    """Packs blocks of documents; ``emit(tier, pieces)`` gets every window once it is full."""

    def __init__(self, tiers: tuple[int, ...], emit: Callable[[int, list[Piece]], None]):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.emit = emit
        self.open: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        self.used = dict.fromkeys(self.tiers, 0)

    def _put(self, tier: int, piece: Piece) -> None:
        self.open[tier].append(piece)
        self.used[tier] += len(piece)
        if self.used[tier] == tier:
            self.emit(tier, self.open[tier])
            self.open[tier], self.used[tier] = [], 0

    def block(self, docs: list[Piece]) -> None:
        longest = self.tiers[0]
        pools: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        for piece in docs:
            while len(piece) >= longest:
                head, piece = piece.cut(longest)
                self.emit(longest, [head])
            if len(piece):
                pools[next(t for t in reversed(self.tiers) if t >= len(piece))].append(piece)
        # All that is not placed yet, shortest first; a tier's own documents are those at the end.
        waiting = sorted((p for pool in pools.values() for p in pool), key=len)
        sizes = [len(p) for p in waiting]
        for place, tier in enumerate(self.tiers):
            floor = self.tiers[place + 1] if place + 1 < len(self.tiers) else 0
            while sizes and sizes[-1] > floor:
                sizes.pop()
                piece = waiting.pop()
                gap = tier - self.used[tier]
                while len(piece) > gap and (fit := bisect.bisect_right(sizes, min(gap, floor))):
                    sizes.pop(fit - 1)
                    self._put(tier, waiting.pop(fit - 1))
                    gap = tier - self.used[tier]
                while len(piece) > gap:
                    head, piece = piece.cut(gap)
                    self._put(tier, head)
                    gap = tier - self.used[tier]
                self._put(tier, piece)

    def close(self) -> None:
        """Empty the open windows: fill the longest from the shorter ones, then cut at powers of two."""
        rest = [p for t in self.tiers for p in self.open[t]]
        left = sum(map(len, rest))
        window: list[Piece] = []
        size = want = 0
        for piece in rest:
            while len(piece):
                if not want:
                    want = size = self.tiers[0] if left >= self.tiers[0] else 1 << (left.bit_length() - 1)
                head, piece = piece.cut(min(want, len(piece)))
                window.append(head)
                want -= len(head)
                left -= len(head)
                if not want:
                    self.emit(size, window)
                    window = []


class StepDealer:
    """Deals windows of one size to step groups of ``step_tokens`` tokens, costly windows spread over ``groups`` open ones."""

    def __init__(self, step_tokens: int, groups: int):
        self.step_tokens, self.groups, self.held, self.next = step_tokens, groups, {}, 0

    def add(self, tier: int, window: list[Piece]) -> Iterator[tuple[int, int, list[Piece]]]:
        held = self.held.setdefault(tier, [])
        held.append(window)
        if len(held) * tier >= self.step_tokens * self.groups:
            yield from self._deal(tier)

    def close(self) -> Iterator[tuple[int, int, list[Piece]]]:
        for tier in list(self.held):
            yield from self._deal(tier)

    def _deal(self, tier: int) -> Iterator[tuple[int, int, list[Piece]]]:
        held = sorted(self.held.pop(tier), key=lambda w: -sum(len(p) ** 2 for p in w))
        per_step = max(1, self.step_tokens // tier)
        n = -(-len(held) // per_step)
        for k, window in enumerate(held):
            row, column = divmod(k, n)
            yield self.next + (column if row % 2 == 0 else n - 1 - column), tier, window
        self.next += n


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tiers: tuple[int, ...] = (4096, 2048, 1024, 512), step_tokens: int = 32768, groups: int = 8) -> DataFrame:
    """Per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``.

    Each document's ids, and ``end_id`` after them, lie in exactly one piece each. ``tier`` is the sequence's size; every sequence is
    full, so ``tiers`` must be powers of two. Null text is empty (one piece, the end). Null and repeated ids are documents
    of their own; other columns are ignored; an empty table gives no pieces.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    shared = docs.sparkSession.sparkContext.broadcast(TokenizerFile.read(tokenizer))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(shared.value)
        first = TaskContext.get().partitionId() << LOCAL_BITS
        full: list[tuple[int, list[Piece]]] = []
        packer, dealer, count = TierPacker(tiers, lambda tier, pieces: full.append((tier, pieces))), StepDealer(step_tokens, groups), 0

        def rows(dealt) -> list[tuple]:
            nonlocal count
            out = []
            for step, tier, window in dealt:
                offset = 0
                for p in window:
                    out.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, first + count, offset, tier, first + step))
                    offset += len(p)
                count += 1
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)

        for batch in batches:
            block = []
            names = batch.column(0).to_pylist()
            for first_row, flat, edge in encoder.lists(batch.column(1)):
                held, edge = flat.tobytes(), (4 * edge).tolist()
                for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                    ids = held[a:b] + end
                    block.append(Piece(names[first_row + k], 0, memoryview(ids), len(ids) // 4))
            packer.block(block)
            out = []
            for tier, window in full:
                out += rows(dealer.add(tier, window))
            full.clear()
            # Held windows outlive their batch; give them their own few bytes.
            for window in [*(w for ws in dealer.held.values() for w in ws), *packer.open.values()]:
                for p in window:
                    p.ids = memoryview(bytes(p.ids))
            if out:
                yield batch_of(out)
        packer.close()
        out = []
        for tier, window in full:
            out += rows(dealer.add(tier, window))
        out += rows(dealer.close())
        if out:
            yield batch_of(out)

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
