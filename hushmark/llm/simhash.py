"""SimHash near-dedup: fingerprints linked through tables of pivot distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_hot, only, row_key, written

SEED = 42
BLOCKS = (13, 13, 13, 13, 12)  # 3 differing bits leave at least two of five blocks equal
TILE = 2048
STEP = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit majority of the XXH64 of all ``size``-word shingles; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the blanks 20, 09-0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(words) - size + 1)
    stops = (ends - 1)[-n:].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[i : min(n, i + STEP)], stops[i : i + STEP])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, uid, k1, k2, fp``: the fingerprint as a signed long; the text stays behind."""
    k1, k2 = row_key(doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(fps)], ["doc_id", "uid", "k1", "k2", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, uid long, k1 long, k2 long, fp long")


def pivots(n: int = 16) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, …; about 32 bits from each other."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def linked(group: np.ndarray, fps: np.ndarray, bits: int, refs: np.ndarray) -> np.ndarray:
    """For each row the first row of its linked set inside its group (rows come sorted by group).

    Rows are ordered by their distance to the first pivot. Row i is then compared with
    rows i+1, i+2, … of its group until that coordinate alone differs by more than
    ``bits``. Of these pairs the largest difference over all pivots discards (the
    triangle inequality), and what survives is verified on the bits.
    """
    table = distance_table(fps, refs)
    order = np.lexsort((table[:, 0], group))
    group, fps, table = group[order], fps[order], table[order]
    root = np.arange(len(fps))
    open_ = np.arange(len(fps) - 1)
    for k in range(1, len(fps)):
        open_ = open_[open_ < len(fps) - k]
        other = open_ + k
        near = (group[other] == group[open_]) & (table[other, 0] - table[open_, 0] <= bits)
        open_, other = open_[near], other[near]
        if not len(open_):
            break
        i, j = open_, other
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        for some in (slice(1, 4), slice(4, None)):
            close = np.abs(table[i, some] - table[j, some]).max(axis=1, initial=0) <= bits
            i, j = i[close], j[close]
        close = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        i, j = i[close], j[close]
        joined = False
        for a, b in zip(i.tolist(), j.tolist()):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                joined = True
        while joined and (root != root[root]).any():
            root = root[root]
    out = np.empty(len(fps), np.int64)
    out[order] = order[root]
    return out


def links(fps: DataFrame, bits: int = 3, n_pivots: int = 16, tile: int = TILE) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that join exactly those within ``bits`` (≤ 3).

    Two fingerprints within 3 bits agree on two of five blocks, so they share one of ten
    cells. Cells of one row go away by counting. A large cell is cut into tiles, and each
    pair of tiles is a task's unit of its own; inside it the pivot tables decide. A unit
    returns a forest (a row and the first of its set), never all pairs.
    """
    if bits > len(BLOCKS) - 2:
        raise ValueError("cells of two equal blocks find at most 3 differing bits")
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [f"(shiftrightunsigned(fp, {a}) & {(1 << w) - 1})" for a, w in zip(at, BLOCKS)]
    keys = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    cell = "array(" + ", ".join(f"shiftleft({n}L, 32) | shiftleft({block[i]}, 16) | {block[j]}" for n, (i, j) in enumerate(keys)) + ")"
    rows = fps.select("fp", F.explode(F.expr(cell)).alias("cell"))
    sizes = written(rows.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"), "cells")
    shared = join_hot(rows, sizes, "cell", "size", max(fps.count() * len(keys), 1)).where("size IS NOT NULL")
    parts = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = shared.select("fp", "cell", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    unit = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    refs = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, values in whole_groups(batches):
            found = linked(group, values.view(np.uint64), bits, refs)
            a, b = values, values[found]
            off = found != np.arange(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(a[off]), pa.array(b[off])], ["a", "b"])

    units = pairs.select(unit.alias("unit"), "fp").repartition("unit").sortWithinPartitions("unit")
    return units.mapInArrow(run, "a long, b long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted batches of two long columns, cut only where the first one changes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        g, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(g):
            continue
        cut = int(np.searchsorted(g, g[-1])) if g[0] != g[-1] else 0
        if held and (cut or held[-1][0][-1] != g[0]):
            parts = [*held, (g[:cut], v[:cut])]
            yield tuple(np.concatenate(x) for x in zip(*parts))
            held = []
        elif cut:
            yield g[:cut], v[:cut]
        held.append((g[cut:], v[cut:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, bits: int = 3) -> DataFrame:
    """``doc_id, uid, k1, k2, fp, component_id, kept``, one row per document.

    ``component_id`` is the smallest id reachable over links of at most ``bits`` bits;
    the first row with that id is ``kept``. Null and blank texts have fingerprint 0 and
    link like any other; rows with equal fingerprints are one node. Null ids count
    only where a component has no other id. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, doc_id, text, size), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    nodes = written(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("copies")), "nodes")
    roots = components(links(nodes.select("fp"), bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.count("*").alias("members"))
    total = max(rows.count(), 1)
    labelled = join_hot(rooted, written(firsts, "firsts"), "root", "members", total).select("fp", "copies", "keep")
    found = join_hot(rows, written(labelled, "labels"), "fp", "copies", total)
    return found.select("doc_id", "uid", "k1", "k2", "fp", F.col("keep.doc_id").alias("component_id"), (F.col("uid") == F.col("keep.uid")).alias("kept"))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with the first document of every component, all columns as they were."""
    return only(docs, near_dedup(docs, doc_id, text, size, bits).where("kept"), doc_id, text)
