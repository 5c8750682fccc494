"""Embedding near-dedup: tiles compared along the principal axes, cut short by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, join_hot, written

TILE = 4096  # vectors in a tile
BLOCK = 1024  # rows of a tile compared at a time
STEPS = (8, 16, 32)  # axes accumulated before each bound
BOXED = 16  # leading axes whose range in a tile is kept
SIGNS = 12  # leading axes whose signs order the vectors
SLACK = 1e-9  # rounding that a bound may be off by


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def checked(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, uid, raw``: components as little-endian doubles; null where a vector links with nothing."""
    kind = vectors.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column("embedding"):
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0 if v.is_valid and v.values.null_count == 0 else np.zeros(0)
                # a norm that leaves the range of doubles would make every cosine undefined
                with np.errstate(over="ignore"):
                    norm = np.sqrt(x @ x)
                raw.append(x.tobytes() if len(x) and np.isfinite(norm) and norm > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("uid"), pa.array(raw, pa.binary())], ["vec_id", "uid", "raw"])

    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.monotonically_increasing_id().alias("uid"), F.col(embedding).alias("embedding"))
    return rows.mapInArrow(run, f"vec_id {kind}, uid long, raw binary")


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Axes of all unit vectors in descending order of their second moment, from sums per task and component pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = unit(np.frombuffer(b"".join(batch.column("raw").to_pylist()), "<f8").reshape(-1, dim))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "v"])

    cells = classes.select("raw").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # dim * dim rows
    moment = np.zeros(dim * dim)
    for r in cells:
        moment[r.cell] = r.v
    moment = moment.reshape(dim, dim)
    return np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1].copy()


def tiles(classes: DataFrame, axes: np.ndarray, tile: int = TILE) -> DataFrame:
    """``at, nodes, copies, raw, low, high``: vectors in the order of their signs on the leading axes, cut into tiles."""
    dim = len(axes)
    boxed = min(BOXED, dim)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = unit(np.frombuffer(b"".join(batch.column("raw").to_pylist()), "<f8").reshape(-1, dim)) @ axes[:, : min(SIGNS, dim)]
            code = (p > 0) @ (1 << np.arange(p.shape[1])[::-1])
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("raw"), pa.array(code.astype(np.int64)), pa.array(p[:, 0])], ["node", "copies", "raw", "code", "lead"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            raw = b"".join(rows.column("raw").to_pylist())
            p = unit(np.frombuffer(raw, "<f8").reshape(-1, dim)) @ axes[:, :boxed]
            nodes, copies = (rows.column(c).to_numpy().astype("<i8").tobytes() for c in ("node", "copies"))
            return pa.RecordBatch.from_pydict(
                {"at": pa.array([at], pa.int64()), "nodes": [nodes], "copies": [copies], "raw": [raw], "low": pa.array([p.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([p.max(axis=0)], pa.list_(pa.float64()))}
            )

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= tile:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, tile))
                at += 1
                held = rows.slice(tile).to_batches()
        if sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    keys = classes.select("node", "copies", "raw").mapInArrow(keyed, "node long, copies long, raw binary, code long, lead double")
    ordered = keys.repartitionByRange("code", "lead").sortWithinPartitions("code", "lead")
    return ordered.select("node", "copies", "raw").mapInArrow(cut, "at long, nodes binary, copies binary, raw binary, low array<double>, high array<double>")


def near_pairs(tiled: DataFrame, least: float) -> DataFrame:
    """``i, j``: pairs of tiles (a tile with itself too) that can hold a cosine of ``least``.

    Unit vectors that near lie within sqrt(2 - 2 least) of each other, so where the ranges
    of the leading axes lie further apart the pair needs no look.
    """
    meta = tiled.select("at", "low", "high")
    n = meta.count()
    # one row per tile: numbering them moves no vectors
    number = meta.withColumn("n_", (F.row_number().over(Window.orderBy("at")) - 1).cast("long"))
    ahead = number.select(F.col("at").alias("i"), "n_", F.col("low").alias("a"), F.col("high").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("d"))
    ahead = ahead.where(f"d * 2 < {n} OR n_ < d").withColumn("n_", (F.col("n_") + F.col("d")) % max(n, 1))
    pairs = ahead.join(number.select(F.col("at").alias("j"), "n_", "low", "high"), "n_")
    gap = "aggregate(transform(sequence(0, size(a) - 1), k -> greatest(0D, a[k] - high[k], low[k] - b[k])), 0D, (s, g) -> s + g * g)"
    return pairs.where(f"{gap} <= {2 - 2 * least + SLACK}").select("i", "j")


def matches(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two sets of vectors with a cosine of at least ``least``.

    The leading axes are multiplied first. What the others can add is bounded by the
    product of the suffix norms; pairs that cannot reach ``least`` stop there. Pairs that
    are left are verified on the vectors themselves, in double precision.
    """
    x, y = unit(a) @ axes, unit(b) @ axes
    dim = x.shape[1]
    ends = [s for s in STEPS if s < dim]
    dot = np.zeros((len(x), len(y)))
    i = j = None
    start = 0
    for end in ends:
        rest = [np.sqrt(np.maximum(0, 1 - (v[:, :end] ** 2).sum(axis=1))) for v in (x, y)]
        if i is None:
            dot += x[:, start:end] @ y[:, start:end].T
            alive = dot + rest[0][:, None] * rest[1][None, :] >= least - SLACK
            count = int(np.count_nonzero(alive))
            if not count:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if count * 16 < alive.size:  # few are left: go on pair by pair
                i, j = np.nonzero(alive)
                some = dot[i, j]
        else:
            some = some + np.einsum("ij,ij->i", x[i, start:end], y[j, start:end])
            alive = some + rest[0][i] * rest[1][j] >= least - SLACK
            i, j, some = i[alive], j[alive], some[alive]
        start = end
    if i is None:
        i, j = np.nonzero(dot + x[:, start:] @ y[:, start:].T >= least - SLACK)
    near = np.zeros(len(i), bool)
    sizes = [np.linalg.norm(v, axis=1) for v in (a, b)]
    for s in range(0, len(i), 1 << 17):
        r, c = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
        near[s : s + (1 << 17)] = np.einsum("ij,ij->i", a[r], b[c]) / (sizes[0][r] * sizes[1][c]) >= least
    return i[near], j[near]


def compared(left: tuple, right: tuple | None, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``node, links, root`` of the vectors of one or two tiles that have a link there; never the links themselves."""
    nodes, copies, raw = left if right is None else (np.concatenate(p) for p in zip(left, right))
    n = len(left[0])
    links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    first = [(s, min(s + BLOCK, n)) for s in range(0, n, BLOCK)]
    second = first if right is None else [(s, min(s + BLOCK, len(nodes))) for s in range(n, len(nodes), BLOCK)]
    for a, b in first:
        for c, d in second:
            if right is None and c < a:
                continue
            i, j = matches(raw[a:b], raw[c:d], axes, least)
            i, j = i + a, j + c
            if a == c:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while True:  # both ends of a link take over the smaller root
                low = np.minimum(root[i], root[j])
                if (root[i] == low).all() and (root[j] == low).all():
                    break
                np.minimum.at(root, root[i].copy(), low)
                np.minimum.at(root, root[j].copy(), low)
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                while (root != root[root]).any():
                    root = root[root]
    some = np.flatnonzero(links)
    return nodes[some], links[some], nodes[root[some]]


def linked(tiled: DataFrame, pairs: DataFrame, axes: np.ndarray, least: float) -> DataFrame:
    """``node, links, root`` from all near pairs of tiles; a pair of tiles is a unit of work."""
    body = ["nodes", "copies", "raw"]
    left = pairs.join(tiled.select(F.col("at").alias("i"), *body), "i")
    right = pairs.where("i != j").join(tiled.select(F.col("at").alias("j"), *(F.col(c).alias(f"{c}_2") for c in body)), "j")
    both = left.join(right, ["i", "j"], "left").select(*body, *(f"{c}_2" for c in body))
    dim = len(axes)

    def side(r: dict, tail: str) -> tuple | None:
        if r["raw" + tail] is None:
            return None
        return tuple(np.frombuffer(r[c + tail], "<i8") for c in ("nodes", "copies")) + (np.frombuffer(r["raw" + tail], "<f8").reshape(-1, dim),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                found = compared(side(r, ""), side(r, "_2"), axes, least)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "links", "root"])

    return both.mapInArrow(run, "node long, links long, root long")


def vector_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per vector.

    Two vectors link at a cosine of ``least`` or more. Vectors that are null, zero, not
    finite or of another length than most link with nothing and stay. Equal vectors are
    compared once and link with each other. ``component_id`` is the smallest id reachable;
    the first row with it is kept. Null ids count only where a component has no other;
    rows that repeat are vectors of their own; other columns are ignored; an empty table
    gives no rows.
    """
    rows = written(checked(vectors, vec_id, embedding), "vectors")
    total = max(rows.count(), 1)
    lengths = rows.where("raw IS NOT NULL").groupBy(F.octet_length("raw").alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "b").first()
    size = lengths.b if lengths else 8
    valid = F.col("raw").isNotNull() & (F.octet_length("raw") == size)
    first = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "uid"))
    classes = written(rows.where(valid).groupBy("raw").agg(F.min("uid").alias("node"), first.alias("first"), F.count("*").alias("copies")), "classes")
    axes = principal_axes(classes, size // 8)
    tiled = written(tiles(classes, axes, tile), "tiles")
    found = written(linked(tiled, near_pairs(tiled, least), axes, least), "links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "root")
    rooted = classes.join(sums, "node", "left").join(roots, "node", "left")
    rooted = written(rooted.select("raw", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "rooted")
    firsts = written(rooted.groupBy("root").agg(F.min("first").alias("keep"), F.count("*").alias("members")), "firsts")
    labelled = join_hot(rooted.drop("first"), firsts, "root", "members", total)
    answer = join_hot(rows, written(labelled.select("raw", "copies", "links", "keep"), "labels"), "raw", "copies", total)
    alone = F.col("copies").isNull()
    return answer.select(
        "vec_id",
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("keep.vec_id")).alias("component_id"),
        F.when(alone, True).otherwise(F.col("uid") == F.col("keep.uid")).alias("kept"),
    )
