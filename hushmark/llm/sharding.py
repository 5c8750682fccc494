"""Sharding by histogram sort: splitters are found by counting bytes below probes, then rows move once."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from .common import fresh, partitions, written

OVERHEAD = 16  # bytes a row counts besides its text
RANGE_BYTES = 1 << 27  # a shard is exchanged in ranges of about this size
MOST_RANGES = 1 << 15  # of all shards together; also bounds what a round returns to the driver
PROBES = 16  # new candidate boundaries for each open splitter and round
HALF = 64
END = 1 << 128


class Edge(NamedTuple):
    """A boundary with what lies below it, exactly counted."""

    key: int
    bytes: int
    rows: int


def keys_of(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """The sort key: a hash of the text, so that equal texts are neighbours, then one of the rest of the row."""
    plain = [f.name for f in docs.schema if f.name != text and not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    rest = [doc_id, *sorted(c for c in plain if c != doc_id)]
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(*(F.col(c) for c in rest))


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that sort like the two unsigned numbers."""
    out = np.empty((len(high), 2), ">u8")
    out[:, 0], out[:, 1] = high.view(np.uint64), low.view(np.uint64)
    return out.view("S16").ravel()


def _bytes(key: int) -> bytes:
    return b"\xff" * 17 if key >= END else key.to_bytes(16, "big")


def counted(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """For each gap between probes that holds rows: bytes, rows, least and greatest key."""
    cuts = keys.sparkSession.sparkContext.broadcast(np.array([_bytes(p) for p in probes], "S17"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(cuts.value) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.full(n, b"\xff" * 17, "S17"), np.zeros(n, "S17")
        for batch in batches:
            key = _packed(np.array(batch.column(0)), np.array(batch.column(1)))
            order = np.argsort(key, kind="stable")
            key = key[order]
            ends = np.append(np.searchsorted(key, cuts.value), len(key))
            starts = np.append(0, ends[:-1])
            total = np.append(0, np.cumsum(np.array(batch.column(2))[order]))
            size += total[ends] - total[starts]
            rows += ends - starts
            full = np.flatnonzero(ends > starts)
            first, last = key[starts[full]], key[ends[full] - 1]
            low[full] = np.where(first < low[full], first, low[full])
            high[full] = np.where(last > high[full], last, high[full])
        full = np.flatnonzero(rows)
        text = lambda x: pa.array([v.ljust(16, b"\0") for v in x.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(size[full]), pa.array(rows[full]), text(low[full]), text(high[full])], ["gap", "bytes", "rows", "low", "high"]
        )

    parts = keys.select("high", "low", "size").mapInArrow(run, "gap long, bytes long, rows long, low binary, high binary")
    sums = parts.groupBy("gap").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    return {r.gap: (r.bytes, r.rows, int.from_bytes(r.low, "big"), int.from_bytes(r.high, "big")) for r in sums.coalesce(1).toLocalIterator()}


def splitters(keys: DataFrame, targets: list[tuple[int, int]]) -> list[Edge]:
    """For each target ``(bytes below, tolerance)`` a boundary that meets it, or the nearest there is.

    Each round counts exactly what lies below some probes inside every interval that still holds
    a target. An interval shrinks to the keys that occur in it, so a round never probes empty
    space. While it holds several texts, probes fall between texts; only when a single text's copies
    overshoot the tolerance on both sides are they cut apart, by the second half of the key.
    """
    spans = counted(keys, [])
    if not spans:
        return [Edge(0, 0, 0) for _ in targets]
    total, rows, least, most = spans[0]
    edges = [Edge(0, 0, 0), Edge(END, total, rows)]
    inside = {0: (least, most)}  # by the lower edge of a gap that was split: the keys that occur in it
    while True:
        sizes = [e.bytes for e in edges]
        found: list[Edge] = []
        asked: dict[int, list[int]] = {}
        for want, slack in targets:
            at = bisect_right(sizes, want) - 1
            near = edges[at], edges[min(at + 1, len(edges) - 1)]
            found.append(min(near, key=lambda e: abs(e.bytes - want)))
            if abs(found[-1].bytes - want) > slack and (cuts := _probes(*inside[near[0].key])):
                asked[near[0].key] = cuts
        if not asked:
            return found
        probes = sorted({c for cuts in asked.values() for c in cuts})
        spans = counted(keys, probes)
        place = {c: i for i, c in enumerate(probes)}
        size = n = 0
        for gap, cut in enumerate(probes):
            size, n = size + spans.get(gap, (0, 0))[0], n + spans.get(gap, (0, 0))[1]
            edges.append(Edge(cut, size, n))
        for lower, cuts in asked.items():
            first, last = inside[lower]
            inside[lower] = first, spans[place[cuts[0]]][3]
            for cut in cuts:
                if place[cut] + 1 in spans:
                    inside[cut] = spans[place[cut] + 1][2:]
            inside[cuts[-1]] = inside[cuts[-1]][0], last
        edges.sort()


def _probes(first: int, last: int) -> list[int]:
    """Boundaries above ``first``, up to ``last``; none if there is but one key."""
    if first == last:
        return []
    shift = HALF if first >> HALF != last >> HALF else 0
    a, b = first >> shift, last >> shift
    return sorted({(a + 1 + (b - a - 1) * j // PROBES) << shift for j in range(PROBES + 1)})


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size, law, shard, slot``: shards 0 to ``shards - 1`` of nearly equal bytes.

    A row counts the UTF-8 bytes of its text (null: none) and 16. Rows are ordered by a hash of the
    text, then by one of their other plain columns. A shard ends at the boundary nearest to its equal share, or at
    one that is off by less than ``tolerance`` of a shard; so two shards differ by less than the largest row, or that much.
    Equal texts lie in one shard, but for groups that no boundary within the tolerance spares: these are
    cut between copies, however large a part of the table they are. ``slot`` counts from 0 in each shard.

    Keys are counted from a written table of 24 bytes a row; each round returns a few numbers for each
    splitter to the driver. Then whole rows move once, in ranges of about 128 MB, several to a shard.

    Null ids are ids like any other; null text differs from the empty text only in the column itself. Rows equal in all plain columns share a key
    and stay together. Very long texts are rows like others: a shard may exceed its share by one. An empty table gives
    no rows, fewer rows than shards leave shards empty. Columns that clash with a new one stay; the new one gets underscores.
    """
    spark = docs.sparkSession
    high, low = keys_of(docs, doc_id, text)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    keys = written(docs.select(high.alias("high"), low.alias("low"), size.alias("size")), "keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    each = max(1, min(MOST_RANGES // shards, max(-(-total // (RANGE_BYTES * shards)), partitions(spark) // shards)))
    n = shards * each
    share = total / shards
    # cuts between shards are as exact as asked; those inside one only spread the work
    targets = [(total * i // n, int(share * tolerance) if i % each == 0 else int(share / each * 0.1)) for i in range(1, n)]
    edges = [Edge(0, 0, 0), *splitters(keys, targets)]
    for i in range(1, n):
        edges[i] = max(edges[i], edges[i - 1])
    starts = [(i, i // each, edges[i].rows - edges[i - i % each].rows) for i in range(n)]
    cuts = spark.sparkContext.broadcast(np.array([_bytes(e.key) for e in edges[1:]], "S17"))

    @F.pandas_udf("int")
    def range_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, _packed(a.to_numpy(), b.to_numpy()), side="right").astype(np.int32))

    own = {c: fresh(docs, c) for c in ("size", "law", "shard", "slot", "range_", "high_", "low_")}
    keyed = docs.withColumns({own["high_"]: high, own["low_"]: low, own["size"]: size}).withColumn(own["range_"], range_of(own["high_"], own["low_"]))
    unsigned = [F.col(own[c]).bitwiseXOR(F.lit(-(1 << 63))) for c in ("high_", "low_")]
    nth = F.row_number().over(Window.partitionBy(own["range_"]).orderBy(*unsigned))
    first = spark.createDataFrame(starts, f"`{own['range_']}` int, `{own['shard']}` int, first_ long")
    moved = keyed.repartitionById(n, F.col(own["range_"])).withColumn(own["slot"], nth)
    placed = moved.join(F.broadcast(first), own["range_"], "left")  # at most MOST_RANGES rows
    return placed.select(
        *(F.col(f"`{c}`") for c in docs.columns), own["size"], F.lit("bytes").alias(own["law"]), own["shard"],
        (F.col("first_") + F.col(own["slot"]) - 1).alias(own["slot"]),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write a folder ``shard=N`` for each shard, rows in order of ``slot`` inside each file."""
    sharded = shard_documents(docs, **options)
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
