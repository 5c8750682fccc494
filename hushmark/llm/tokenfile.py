"""Token files: ids in Simple-8b words, in blocks of whole documents, with an index of parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vocab import vocabulary

COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])  # ids in a word, by selector
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 0  # the payload is the place of the id in the block's list of raw 64-bit ids
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
STRETCH = 128  # words between two entries of the offset list
RUN = 16384  # ids that are decoded together
BLOCK = 65536  # ids, at least, before a block is closed


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words, offsets, escapes``: each word takes as many of the next ids as fit one of its layouts."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), ids
    width = np.zeros(n + 64, np.uint8)  # zeros after the end fit any layout
    exact = ids < 1 << 53  # a double holds these, and its exponent is their width
    width[:n] = np.where(exact, np.frexp(ids.astype(np.float64))[1], np.searchsorted(_POWERS, ids, side="right") if not exact.all() else 0)
    tops = {1: width}
    for c in (2, 4, 8, 16, 32):
        half = tops[c // 2]
        tops[c] = np.maximum(half[: len(half) - c // 2], half[c // 2 :])
    choice = np.zeros(n, np.uint8)
    for s in range(14, 0, -1):
        c, p = int(COUNTS[s]), 1 << (int(COUNTS[s]).bit_length() - 1)
        top = tops[p]
        np.putmask(choice, np.maximum(top[:n], top[c - p : c - p + n]) <= BITS[s], s)
    step = COUNTS.astype(np.uint8)[choice].tobytes()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    kind = choice[at]
    words = kind.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(64, np.uint64)])
    for s in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == s)
        if s == ESCAPE:
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
            continue
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        values = padded[at[rows][:, None] + np.arange(COUNTS[s])] << shifts
        words[rows] |= np.bitwise_or.reduce(values, axis=1)
    return words, at[::STRETCH].astype(np.uint32), ids[at[kind == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of some words, one gather for each layout that occurs."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[kind])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - COUNTS[kind]
    for s in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[starts[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        out[starts[rows][:, None] + np.arange(COUNTS[s])] = (words[rows][:, None] >> shifts) & np.uint64((1 << int(BITS[s])) - 1)
    return out[:n]


def unpack_range(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a block; only the stretches that hold them are decoded."""
    if first >= last:
        return np.zeros(0, np.uint64)
    a = int(np.searchsorted(offsets, first, side="right")) - 1
    b = int(np.searchsorted(offsets, last, side="left"))
    base = int(offsets[a])
    return unpack(words[a * STRETCH : b * STRETCH], escapes, last - base)[first - base :]


SCHEMA = "part int, block int, first long, n_ids long, doc_ids array<{id}>, lengths array<long>, words binary, offsets binary, escapes binary"


def write_tokens(docs: DataFrame, path: str, vocab: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encode whole texts and write them below ``path`` in ascending order of ``doc_id``.

    ``path/blocks`` holds a row per block of whole documents: their ids, lengths and
    Simple-8b words, the offsets of every 128th word and the raw ids too wide for a word.
    ``path/index`` holds a row per part: the ids before it. Parts are ranges of ``doc_id`` and, inside
    an id, of row numbers: null ids come first, rows that repeat an id follow in any order, and an id that a third of
    the rows share is spread over parts like any other stretch. Null text is empty, and each document ends with
    ``end_id``. The ids of a text are those of the library's plain call, strings of special tokens included. A very long
    text is a block of its own, held by one task. Other columns are ignored, whatever their names. An empty table
    writes no block.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(vocab).encode_all
        part, block, first = TaskContext.get().partitionId(), 0, 0
        docs_in: list = []
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            words, offsets, escapes = pack(ids)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                    "first": [first], "n_ids": [len(ids)],
                    "doc_ids": pa.array([docs_in], pa.list_(id_type)), "lengths": pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                    "words": [words.astype("<u8").tobytes()], "offsets": [offsets.astype("<u4").tobytes()], "escapes": [escapes.astype("<u8").tobytes()],
                }
            )

        size = 0
        for batch in batches:
            id_type = batch.column(0).type
            for i, found in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                held.append(np.append(found, np.uint32(end_id)))
                docs_in.append(i)
                size += len(held[-1])
                if size >= BLOCK:
                    yield row()
                    block, first, size, docs_in, held = block + 1, first + size, 0, [], []
        if held:
            yield row()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id").drop("row")
    ordered.mapInArrow(run, SCHEMA.format(id=kind)).write.parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.parquet(f"{path}/blocks")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per part: a part is a task of the write above
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts.select("part", "n_ids", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document of a token file; ``ids`` as little-endian 32-bit integers.

    The offsets of a block lead to the words that hold a document: a few documents at a time are decoded, from their
    own stretches of words, so what is in memory is a block as written and about ``RUN`` ids. A file without blocks
    gives no rows; null and repeated ids come back as written.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                words, offsets, escapes = (np.frombuffer(r[c].as_buffer(), t) for c, t in (("words", "<u8"), ("offsets", "<u4"), ("escapes", "<u8")))
                lengths = r["lengths"].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                data, a = [], 0
                while a < len(ends):
                    b = max(a + 1, int(np.searchsorted(ends, starts[a] + RUN, side="right")))
                    ids = unpack_range(words, offsets, escapes, int(starts[a]), int(ends[b - 1])).astype("<u4")
                    data += [ids[x - starts[a] : y - starts[a]].tobytes() for x, y in zip(starts[a:b], ends[a:b], strict=True)]
                    a = b
                before = r["first"].as_py() + r["before"].as_py()
                yield pa.RecordBatch.from_arrays([r["doc_ids"].values, pa.array(starts + before), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])

    index = spark.read.parquet(f"{path}/index").select("part", "before")
    whole = blocks.join(F.broadcast(index), "part")  # the index has a row per part, and a part is a task of the write
    return whole.mapInArrow(run, f"doc_id {kind}, start long, ids binary")
