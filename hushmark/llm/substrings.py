"""Suffix-array dedup: bytes covered by a string of a fixed length that also starts earlier."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LENGTH = 100
GRAM = 24
SLICE = 1 << 20  # bytes hashed at a time; places within a slice take the low 20 bits of a key
CHUNK = 4096  # candidate segments in one suffix array
NO_ID = -(2**63)  # stands for a null id while rows are ordered

_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes that start in ``data``, by differences of running sums (mod 2^64)."""
    if not _POWERS:
        _POWERS.extend((_powers(_BASE), _powers(pow(_BASE, -1, 2**64))))
    up, down = _POWERS
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * down[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * up[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def owned_starts(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash, first, count``: runs of window starts that share the gram of least hash in their window.

    Which gram a window picks depends on its bytes alone, so equal windows, wherever they
    stand, belong to runs with equal hashes. ``ends``: where documents end in ``data``.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none
    h = gram_hashes(data)
    low = np.uint64(SLICE - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    grams, have = length - GRAM + 1, 1
    while have * 2 <= grams:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - (grams - have)], least[grams - have :])
    at = np.arange(len(least))
    room = ends[np.searchsorted(ends, at, side="right")] - at
    starts = at[room >= length]
    if not len(starts):
        return none.view(np.uint64), none, none
    pick = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return h[pick[new]], starts[new], np.diff(np.append(new, len(starts)))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row starts and ends; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    return np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8), offsets


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """``h, doc, k, pos``: every run of window starts; ``pos`` holds the first start and, in the low 7 bits, the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch.column("text"))
            doc, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            i = 0
            while i < len(doc):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
                for a in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j]) - length + 1), SLICE - length + 1):
                    # one slice but for a text longer than a slice, whose slices overlap by length - 1
                    b = min(a + SLICE, int(offsets[j]))
                    ends = np.minimum(offsets[i + 1 : j + 1], b) - a
                    h, first, count = owned_starts(data[a:b], ends, length)
                    row = i + np.searchsorted(ends, first, side="right")
                    pos = (first + a - offsets[row]) << 7 | count
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[row]), pa.array(k[row]), pa.array(pos)], ["h", "doc", "k", "pos"])
                i = j

    return docs.mapInArrow(run, "h long, doc long, k long, pos long")


def candidates(runs: DataFrame) -> DataFrame:
    """Runs whose hash occurs again, in order of (hash, document, place), numbered in chunks.

    Ranges of that order, not of the hash alone, go to the tasks, so a passage that a
    third of all documents share spreads over tasks. The first and last run of a task
    stay in any case, as their like may be in the neighbour.
    """
    keys, names = ["h", "doc", "k", "pos"], ["g", "doc", "k", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, group = TaskContext.get().partitionId() << 32, 0, 0
        last: int | None = None
        held: list[np.ndarray] | None = None
        before: int | None = None

        def out(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            nonlocal n
            nonlocal group, last
            h, doc, k, pos = (c[keep] for c in cols)
            chunk = task + (n + np.arange(len(h))) // CHUNK
            n += len(h)
            if len(h):
                # a number for each hash of this task stands for it from here on
                new = np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]])
                ordinal = group + np.cumsum(new)
                group, last = int(ordinal[-1]), int(h[-1])
            else:
                ordinal = h
            return pa.RecordBatch.from_arrays([pa.array(ordinal.astype(np.int32)), *(pa.array(c) for c in (doc, k, pos, chunk))], [*names, "chunk"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            h = cols[0]
            again = h[1:] == h[:-1]
            keep = np.append(again, False) | np.concatenate([[before is None or h[0] == before], again])
            held = [c[-1:] for c in cols]
            before = int(h[-2]) if len(h) > 1 else before
            if len(h) > 1:
                yield out([c[:-1] for c in cols], keep[:-1])
        if held is not None:
            yield out(held, np.ones(1, bool))

    return runs.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, "g int, doc long, k long, pos long, chunk long")


def segments(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The bytes of each candidate run: from its first start to the end of its last window.

    A task sends the same bytes to a chunk once; later rows refer to them by a digest.
    """
    lists = found.groupBy("doc", "k").agg(F.collect_list(F.struct("chunk", "g", "pos")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            data, offsets = _texts(batch.column("text"))
            runs = batch.column("runs")
            counts = np.diff(runs.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), counts)
            chunk, g, pos = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
            first = offsets[row] + (pos >> 7)
            size = (pos & 127) + length - 1
            raw = data.tobytes()
            segs, marks = [], []
            for c, a, n in zip(chunk.tolist(), first.tolist(), size.tolist()):
                seg: bytes | None = raw[a : a + n]
                mark = xxhash.xxh64_intdigest(seg)
                if (c, mark) in sent:
                    seg = None  # this task has sent the chunk these bytes
                else:
                    sent.add((c, mark))
                segs.append(seg)
                marks.append(mark)
            if len(sent) > 1_000_000:
                sent.clear()
            mark = np.array(marks, np.uint64).view(np.int64)
            for i in range(0, len(row), 50_000):
                s = slice(i, i + 50_000)
                cols = [pa.array(chunk[s]), pa.array(g[s]), batch.column("doc").take(pa.array(row[s])), batch.column("k").take(pa.array(row[s])), pa.array(pos[s]), pa.array(mark[s]), pa.array(segs[s], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["chunk", "g", "doc", "k", "pos", "mark", "seg"])

    return docs.join(lists, ["doc", "k"]).select("doc", "k", "text", "runs").mapInArrow(run, "chunk long, g int, doc long, k long, pos long, mark long, seg binary")


class Suffixes:
    """Sorted suffixes of some strings, by two-stage sorting, to a depth of ``length`` bytes.

    Only suffixes smaller than their successors are compared. All others are induced: a
    scan over the buckets of first bytes, in ascending order, puts the predecessor of each
    suffix it meets at the next place of the predecessor's bucket, as that is in order
    once its successor is.
    """

    def __init__(self, strings: list[bytes], length: int):
        self.length, self.pad = length, -(-length // 8) * 8
        sizes = np.array([len(s) for s in strings], np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(sizes + self.pad)])[:-1]
        self.lasts = self.firsts + sizes - 1
        self.owned = sizes - length + 1
        zeros = bytes(self.pad)
        self.data = np.frombuffer(b"".join([s + zeros for s in strings]) + zeros, np.uint8)
        self.words = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[at].astype(np.uint64)

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """Which positions hold a suffix smaller than its successor, and which are needed at all."""
        text, n = self.data, len(self.data)
        last = np.zeros(n, bool)
        last[self.lasts] = True
        inside = np.zeros(n + 1, np.int64)
        inside[self.firsts] += 1
        inside[self.lasts + 1] -= 1
        inside = np.cumsum(inside)[:-1] > 0
        turn = np.flatnonzero((np.append(text[1:] != text[:-1], True) | last) & inside)
        rising = np.append(text[1:] > text[:-1], False)[turn] & ~last[turn]
        at = np.flatnonzero(inside)
        small = np.zeros(n, bool)
        small[at] = rising[np.searchsorted(turn, at)]
        # windows that start in a string, then on to the suffix that orders the last of them
        anchor = np.flatnonzero(small | last)
        stop = anchor[np.searchsorted(anchor, self.firsts + self.owned - 1)]
        span = np.zeros(n + 1, np.int64)
        np.add.at(span, self.firsts, 1)
        np.add.at(span, stop + 1, -1)
        return small, np.cumsum(span)[:-1] > 0

    def sorted_small(self, at: np.ndarray) -> np.ndarray:
        """Positions in order of their next ``length`` bytes; each round sorts what is still tied by one more word."""
        order = np.argsort(self.word(at), kind="stable")
        at = at[order]
        group = np.cumsum(np.concatenate([[True], np.diff(self.word(at)) != 0])) if len(at) else at
        for depth in range(8, self.pad, 8):
            sizes = np.bincount(group, minlength=1)
            tied = np.flatnonzero(sizes[group] > 1)
            if not len(tied):
                break
            word = self.word(at[tied] + depth)
            inner = np.lexsort((word, group[tied]))
            at[tied] = at[tied][inner]
            new = np.zeros(len(at), bool)
            word = word[inner]
            new[tied[1:]] = (word[1:] != word[:-1]) | (group[tied][1:] != group[tied][:-1])
            new |= np.concatenate([[True], group[1:] != group[:-1]])
            group = np.cumsum(new)
        return at

    def array(self) -> np.ndarray:
        """Start positions of all owned windows in order."""
        small, needed = self.kinds()
        text = self.data
        large = needed & ~small
        direct = self.sorted_small(np.flatnonzero(needed & small))
        cuts = np.searchsorted(text[direct], np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

        def induce(after: np.ndarray) -> None:
            before = after - 1
            before = before[(before >= 0) & large[before]]
            if len(before):
                keys = text[before]
                inner = np.argsort(keys, kind="stable")
                before, keys = before[inner], keys[inner]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]).tolist()
                for a, b in zip(edges, edges[1:]):
                    waiting[keys[a]].append(before[a:b])

        induce(self.lasts + 1)  # the empty suffixes come first
        out = []
        for c in range(256):
            for wave in waiting[c]:  # grows while it is walked
                out.append(wave)
                induce(wave)
            part = direct[cuts[c] : cuts[c + 1]]
            if len(part):
                out.append(part)
                induce(part)
        order = np.concatenate(out) if out else direct
        string = np.searchsorted(self.firsts, order, side="right") - 1
        return order[order - self.firsts[string] < self.owned[string]]

    def common_prefixes(self, order: np.ndarray) -> np.ndarray:
        """Bytes that each suffix shares with the one before it, at most ``length``."""
        out = np.zeros(len(order), np.int64)
        alive = np.arange(1, len(order))
        for depth in range(0, self.length, 8):
            x = self.word(order[alive] + depth) ^ self.word(order[alive - 1] + depth)
            out[alive] += 8
            odd = x != 0
            if odd.any():
                high = np.frexp((x[odd] >> np.uint64(8)).astype(np.float64))[1] + 8  # bit length, by byte
                high = np.where(x[odd] < 256, 8, high)
                out[alive[odd]] -= (high + 7) // 8
            alive = alive[~odd]
        return np.minimum(out, self.length)


def repeats(table: pa.Table, length: int) -> pa.Table:
    """Windows of one chunk that start again earlier in it; of runs cut by the chunk's ends, also the first windows.

    Returns ``doc, k, a, b, w1, w2``. Rows with null ``w2`` are ranges of bytes to remove;
    rows with a digest are windows that no earlier one in this chunk equals, but
    one in another chunk might.
    """
    h, doc, k, pos = (table.column(c).to_numpy() for c in ("g", "doc", "k", "pos"))
    order = np.lexsort((pos, k, doc, h))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = np.all([x[order][1:] == x[order][:-1] for x in (h, doc, k, pos)], axis=0)
    order = order[~same]  # rows that repeat an id and a text are one document
    h, doc, k, pos = (x[order] for x in (h, doc, k, pos))
    marks = table.column("mark").to_numpy()
    texts = {m: t for m, t in zip(marks.tolist(), table.column("seg").to_pylist()) if t is not None}
    kinds, kind = np.unique(marks[order], return_inverse=True)
    suffixes = Suffixes([texts[m] for m in kinds.tolist()], length)
    sa = suffixes.array()
    classes = np.empty(len(suffixes.data), np.int64)
    classes[sa] = np.cumsum(suffixes.common_prefixes(sa) < length)

    count = pos & 127
    row = np.repeat(np.arange(len(pos)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = suffixes.firsts[kind[row]] + step
    cls = classes[place]
    first = np.zeros(len(row), bool)
    first[np.unique(cls, return_index=True)[1]] = True

    start = (pos >> 7)[row] + step
    gone = np.flatnonzero(~first)
    edge = np.ones(len(gone), bool)
    edge[1:] = (np.diff(gone) != 1) | (row[gone][1:] != row[gone][:-1])
    heads = np.flatnonzero(edge)
    tails = np.append(heads[1:], len(gone))[: len(heads)] - 1
    a, b, r = start[gone[heads]], start[gone[tails]] + length, row[gone[heads]]

    open_ = np.flatnonzero(first & ((h[row] == h[0]) | (h[row] == h[-1])))
    raw = suffixes.data.tobytes()
    digests = [xxhash.xxh128_intdigest(raw[p : p + length]) for p in place[open_].tolist()]
    mask = 2**64 - 1
    w1 = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
    w2 = np.array([d & mask for d in digests], np.uint64).view(np.int64)
    ro = row[open_]
    return pa.table(
        {
            "doc": np.concatenate([doc[r], doc[ro]]),
            "k": np.concatenate([k[r], k[ro]]),
            "a": np.concatenate([a, start[open_]]),
            "b": np.concatenate([b, start[open_] + length]),
            "w1": pa.chunked_array([pa.nulls(len(r), pa.int64()), pa.array(w1)]),
            "w2": pa.chunked_array([pa.nulls(len(r), pa.int64()), pa.array(w2)]),
        }
    )


def removed_ranges(segs: DataFrame, length: int) -> DataFrame:
    """``doc, k, a, b``: ranges of bytes covered by windows that start earlier, still overlapping."""
    schema = "doc long, k long, a long, b long, w1 long, w2 long"
    rows = written(segs.groupBy("chunk").applyInArrow(lambda t: repeats(t, length), schema), "ranges", clear=True)
    # a window meets its like of other chunks once per chunk, so these groups stay small
    place = F.struct("doc", "k", "a", "b")
    groups = rows.where("w2 IS NOT NULL").groupBy("w1", "w2").agg(F.collect_list(place).alias("all"), F.min(place).alias("first"))
    again = groups.where("size(all) > 1").select("first", F.explode("all").alias("p")).where("p != first")
    return rows.where("w2 IS NULL").select("doc", "k", "a", "b").unionByName(again.select("p.*"))


def row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "text")


def told_apart(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, k, text``: no two different texts of one id (null ids count as one) have the same ``k``.

    ``k`` is a 64-bit hash. Where rows share an id and a hash, a digest proves that their texts are equal, or else
    another seed is taken.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    for seed in count():
        keyed = rows.select("doc", row_hash(seed).alias("k"), "text")
        if not keyed.groupBy("doc", "k").agg(F.count("*").alias("n")).where("n > 1").head(1):
            return keyed
        proof = F.sha2(F.coalesce("text", F.lit("")), 256)
        clash = keyed.groupBy("doc", "k").agg(F.min(proof).alias("least"), F.max(proof).alias("most")).where("least <> most")
        if not clash.head(1):
            return keyed


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the maximal removed ranges and the bytes that stay, one row per document.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
    smaller id (whole numbers; null ids first), or earlier in the same text. Matches never
    cross texts; null text is empty; texts shorter than ``length`` lose nothing. Rows that
    repeat an id and a text are one document and get the same result; of rows that repeat
    an id alone one counts as the earlier. An empty table gives no rows.

    Very long texts are cut by overlapping slices; other columns are ignored, whatever their names.

    Every window belongs to the gram of least hash in it. Runs of windows whose gram
    occurs again are brought together in order, ``CHUNK`` at a time, and their suffix array
    tells equal windows apart. All steps work on ranges of rows, never on all rows of a
    passage. The texts are shuffled twice, for the cutting out and the putting back; the files of
    a finished shuffle go before the next step begins.
    """
    if not GRAM <= length <= GRAM + 126:
        raise ValueError("a run of starts must fit 7 bits")
    keyed = told_apart(docs, doc_id, text)
    found = written(candidates(anchors(keyed, length)), "candidates", clear=True)
    ranges = removed_ranges(segments(keyed, found, length), length)
    # a range is shorter than 2^9: one number holds its start and its size
    lists = ranges.groupBy("doc", "k").agg(F.collect_list(F.expr("shiftleft(a, 9) | (b - a)")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = _texts(batch.column("text"))
            spans, kept = [], []
            for i, ranges in enumerate(batch.column("ranges")):
                one = data[offsets[i] : offsets[i + 1]]
                merged: list[dict] = []
                for packed in sorted(ranges.values.to_pylist() if ranges.is_valid else []):
                    a = packed >> 9
                    b = a + (packed & 511)
                    if merged and a <= merged[-1]["end"]:
                        merged[-1]["end"] = max(b, merged[-1]["end"])
                    else:
                        merged.append({"start": a, "end": b})
                stays = np.ones(len(one), bool)
                for s in merged:
                    stays[s["start"] : s["end"]] = False
                spans.append(merged)
                kept.append(one[stays].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(np.diff(offsets)), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc", "n_bytes", "spans", "kept"]
            )

    whole = keyed.join(lists, ["doc", "k"], "left").select("doc", "k", "text", "ranges")
    out = whole.mapInArrow(run, "doc long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "spans", "kept")
