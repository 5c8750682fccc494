"""Packing of token sequences by swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vocab import vocabulary

CAPACITY = 2048
GROUP = 16384  # pieces that one task packs together


def pieces(docs: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, uid, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut at ``capacity``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "uid", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(vocab).encode_all
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, found in enumerate(encode(batch.column("text"))):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("uid").take(at), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, uid long, piece int, start long, length long, ids_crc32 long")


class Buckets:
    """Entries by a number from 0 to ``most``; finds the smallest number at or above another that has one."""

    def __init__(self, most: int):
        self.at: list[dict] = [{} for _ in range(most + 1)]
        self.mask = 0

    def add(self, number: int, entry) -> None:
        self.at[number][entry] = None
        self.mask |= 1 << number

    def drop(self, number: int, entry) -> None:
        del self.at[number][entry]
        if not self.at[number]:
            self.mask ^= 1 << number

    def from_(self, number: int) -> Iterator[int]:
        rest = self.mask >> number
        while rest:
            low = (rest & -rest).bit_length() - 1
            yield number + low
            rest &= rest - 1


class Bins:
    """Bins of items, and local search that empties them one after the other.

    Items come in arrival order into the last bin, or a new one (next fit). The emptiest bin A is then taken
    apart by moves that each raise the sum of squared fills: an item moves to a bin with room, is exchanged
    for a shorter one (one for one), or two items are exchanged for one (two for one). All bins B
    on the other side are at least as full as A and gain what A loses, so the sum of squares grows
    with every move and the search ends. Among the moves for an item the one that leaves least room in B is taken.
    """

    TRIES = 6  # entries looked at for one amount of room
    REACH = 64  # amounts of room looked at for one item
    EFFORT = 4  # moves for each item, at most

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.held: list[dict[int, list[int]]] = []  # by bin: items by length
        self.free: list[int] = []
        self.moves = {"move": 0, "one for one": 0, "two for one": 0}
        self.rooms = Buckets(capacity)  # bins by room
        self.swaps = Buckets(capacity)  # (bin, lengths) by room once one or two such items are out
        self.next_fit()

    def next_fit(self) -> None:
        for i, n in enumerate(self.lengths):
            if not self.free or self.free[-1] < n:
                self.held.append({})
                self.free.append(self.capacity)
            self._put(i, len(self.free) - 1)

    def squares(self) -> int:
        return sum((self.capacity - f) ** 2 for f in self.free)

    def count(self) -> int:
        return sum(map(bool, self.held))

    def least(self) -> int:
        """No packing has fewer bins."""
        return -(-sum(self.lengths) // self.capacity)

    def _put(self, i: int, b: int) -> None:
        self.held[b].setdefault(self.lengths[i], []).append(i)
        self.free[b] -= self.lengths[i]

    def _take(self, n: int, b: int) -> int:
        items = self.held[b][n]
        i = items.pop()
        if not items:
            del self.held[b][n]
        self.free[b] += n
        return i

    def _list(self, b: int, listed: bool) -> None:
        """Enter bin ``b`` in the buckets, or strike it out. Full and empty bins are in none."""
        room = self.free[b]
        if not 0 < room < self.capacity:
            return
        one = Buckets.add if listed else Buckets.drop
        one(self.rooms, room, b)
        sizes = sorted(self.held[b])
        for n in sizes:
            one(self.swaps, room + n, (b, (n,)))
        for k, n in enumerate(sizes[: self.TRIES]):
            for m in sizes[k if len(self.held[b][n]) > 1 else k + 1 : self.TRIES]:
                one(self.swaps, room + n + m, (b, (n, m)))

    def search(self, patience: int = 256) -> None:
        """Until the number of bins is the least possible, ``patience`` bins in turn allow no move, or after ``EFFORT``."""
        for b in range(len(self.free)):
            self._list(b, True)
        open_ = [(-f, b) for b, f in enumerate(self.free) if f]
        heapify(open_)
        count, least, stuck, most = self.count(), self.least(), 0, self.EFFORT * len(self.lengths)
        while open_ and count > least and stuck < patience and sum(self.moves.values()) < most:
            known, a = heappop(open_)
            if -known != self.free[a] or not self.held[a]:
                continue
            self._list(a, False)
            before = self.free[a]
            while self.held[a] and self._improve(a, open_):
                pass
            if not self.held[a]:
                count -= 1
                stuck = 0
            else:
                self._list(a, True)
                if self.free[a] > before:
                    heappush(open_, (-self.free[a], a))
                    stuck = 0
                else:
                    stuck += 1

    def _improve(self, a: int, open_: list) -> bool:
        """The best move of one item of A, the longest that has any, or else of two."""
        sizes = sorted(self.held[a], reverse=True)
        near = sizes[: self.TRIES]
        pairs = [(n, m) for k, n in enumerate(near) for m in near[k if len(self.held[a][n]) > 1 else k + 1 :]]
        for given in [*((n,) for n in sizes), *pairs]:
            if found := self._best(given, a):
                self._exchange(a, given, *found, open_)
                kinds = {(1, 0): "move", (2, 0): "move", (1, 1): "one for one"}
                self.moves[kinds.get((len(given), len(found[1])), "two for one")] += 1
                return True
        return False

    def _best(self, given: tuple[int, ...], a: int) -> tuple[int, tuple[int, ...]] | None:
        """The bin, and the lengths of the items it gives, that the given lengths fill best."""
        n = sum(given)
        if n > self.capacity:
            return None
        room = next(self.rooms.from_(n), None)
        if room is not None and room > self.free[a]:  # a bin emptier than A
            room = None
        for tried, v in enumerate(self.swaps.from_(n)):
            if room is not None and room <= v or tried > self.REACH:
                break
            for b, back in islice(self.swaps.at[v], self.TRIES):
                gain = n - sum(back)
                if gain > 0 and len(given) + len(back) <= 3 and self.free[b] <= self.free[a] and self.free[b] - gain >= 0:
                    if self.capacity - self.free[b] + gain > self.capacity - self.free[a]:  # more than a change of names
                        return b, back
        return (next(iter(self.rooms.at[room])), ()) if room is not None else None

    def _exchange(self, a: int, given: tuple[int, ...], b: int, back: tuple[int, ...], open_: list) -> None:
        self._list(b, False)
        taken = [self._take(n, a) for n in given]
        returned = [self._take(n, b) for n in back]
        for i in returned:
            self._put(i, a)
        for i in taken:
            self._put(i, b)
        self._list(b, True)
        if self.free[b]:
            heappush(open_, (-self.free[b], b))


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, patience: int = 256) -> tuple[list[int], list[int]]:
    """``bin, offset`` of each item; no bin holds more than ``capacity``."""
    bins = Bins(lengths, capacity)
    bins.search(patience)
    bin_of, offset = [0] * len(lengths), [0] * len(lengths)
    for b, held in enumerate(bins.held):
        at = 0
        for i in sorted(i for items in held.values() for i in items):
            bin_of[i], offset[i] = b, at
            at += lengths[i]
    return bin_of, offset


def pack_documents(docs: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    Every document is kept whole unless it is longer than ``capacity``. Pieces are dealt
    out evenly, ``GROUP`` to a task, and packed there by ``Bins``, so that a task's work does not grow
    with the input; a group wastes less than one sequence where the search ends at the
    least number. Null text is empty (one piece, the end id); rows that repeat are packed
    each; null ids stay null; very long texts are many full pieces; other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    rows = written(pieces(docs, vocab, doc_id, text, end_id, capacity), "pieces")
    n = max(1, -(-rows.count() // GROUP))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        group = table.column("group")[0].as_py()
        bins, offset = pack_lengths(table.column("length").to_pylist(), capacity)
        table = table.drop_columns(["group"]).append_column("sequence_id", pa.array([(group << 32) + b for b in bins], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from table.to_batches()

    dealt = rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("uid", "piece"), F.lit(n)).cast("int").alias("group"))
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.repartitionById(n, "group").mapInArrow(run, schema)
