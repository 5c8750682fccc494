"""Adaptive thresholds: one baseline per source, learnt from its first kept scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pseudonym, scores
from ..options import Options
from ..plans import scan
from ..sources.folders import join_small, written

GROWTH = 16  # lines looked at in a round, times those of the round before


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """``source, bound, n_lines, more``: the place of each source's ``n``-th line, how many lines that is at most, and whether others follow.

    Each task keeps the ``n`` smallest ids of each source it meets, whatever the order of its rows. Nothing is
    sorted, the text stays where it is, and of a source that holds a third of all lines ``n`` ids per task are sent on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        total: dict[str, int] = {}
        for batch in batches:
            named = batch.column(0).dictionary_encode()
            code, ids = named.indices.to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((ids, code))
            code, ids = code[order], ids[order]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else []
            for a, b in zip(starts, [*starts[1:], len(code)], strict=True):
                source = named.dictionary[int(code[a])].as_py()
                total[source] = total.get(source, 0) + int(b - a)
                old = kept.get(source)
                kept[source] = ids[a:b][:n].copy() if old is None else np.sort(np.concatenate([old, ids[a:b][:n]]), kind="stable")[:n]
        names = list(kept)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([kept[s] for s in names], pa.list_(pa.int64())), pa.array([total[s] for s in names], pa.int64())], ["source", "ids", "total"]
        )

    named = lines.where("source IS NOT NULL AND line_id IS NOT NULL").select(F.col("source").cast("string"), F.col("line_id").cast("long"))
    parts = written(named.mapInArrow(run, "source string, ids array<long>, total long"), "lines")
    totals = parts.groupBy("source").agg(F.sum("total").alias("total"))
    nth = Window.partitionBy("source").orderBy("id")
    ranked = parts.select("source", F.explode("ids").alias("id")).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= n)
    last = ranked.groupBy("source").agg(F.max("id").alias("bound"), F.max("nth").alias("n_lines"))
    return last.join(totals, "source").select("source", "bound", "n_lines", (F.col("total") > F.col("n_lines")).alias("more"))


def samples(lines: DataFrame, options: Options, column: str = "line") -> DataFrame:
    """The first N scored-and-kept leaves of each source: ``source, line_id, pos, score, rank``.

    The first N lines of a source mostly hold them, so only these are opened to leaves. Sources that are still short
    and have more lines go on with ``GROWTH`` times as many, the others are done: what is opened is what the
    samples need, not the whole table, and no more. Lines that share an id are taken together. Lines without a
    source or an id give no samples.
    """
    n = options.adaptive_samples
    done, m, open_ = None, n, lines
    while True:
        bounds = written(first_lines(open_, m), "bounds")
        rows = join_small(open_.select("source", "line_id", column), bounds.select("source", "bound"), "source").where("line_id <= bound")
        leaves = rows.select("source", "line_id", F.explode(F.expr(scan.kept_tokens(column, options))).alias("s"))
        whole = Window.partitionBy("source").orderBy("line_id", "pos")
        first = leaves.select("source", "line_id", F.col("s.pos").alias("pos"), F.col("s.token").alias("token"))
        first = written(first.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n), "samples")
        have = first.groupBy("source").agg(F.count("*").alias("have"))
        short = bounds.join(have, "source", "left").where(F.col("more") & (F.coalesce("have", F.lit(0)) < n))
        short = written(short.select("source", F.lit(True).alias("short")), "short")
        finished = first.join(short, "source", "left").where("short IS NULL").drop("short")
        done = finished if done is None else done.unionByName(finished)
        if not short.head(1):
            break
        m *= GROWTH
        open_ = join_small(lines, short, "source").where("short").drop("short")
    return done.select("source", "line_id", "pos", F.expr(scores.complexity("token", options)).alias("score"), "rank")


def thresholds(sampled: DataFrame, options: Options) -> DataFrame:
    """``source, n, mean, sd, threshold, ready`` and where the baseline froze."""
    n = options.adaptive_samples
    stats = sampled.groupBy("source").agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("sd"),
        F.max(F.struct("line_id", "pos")).alias("last"),
    )
    ready = F.col("n") >= n
    return stats.select(
        "source",
        "n",
        "mean",
        "sd",
        F.when(ready, F.col("mean") + 2 * F.col("sd")).otherwise(F.lit(options.entropy_threshold)).alias("threshold"),
        ready.alias("ready"),
        F.col("last.line_id").alias("last_line"),
        F.col("last.pos").alias("last_pos"),
    )


def redact_adaptive(lines: DataFrame, baseline: DataFrame, options: Options, column: str = "line", out: str = "redacted") -> DataFrame:
    """Redact with each source's own threshold from the leaf after its last sample on.

    No last line means: ready before these lines. The limits are written, so that they are worked out once and their
    size is known to the join; the text is not exchanged while they are few.
    """
    limits = written(baseline.where("ready").select("source", "threshold", "last_line", "last_pos"), "limits")
    joined = pseudonym.with_key(join_small(lines, limits, "source"), options)
    first = (
        "CASE WHEN threshold IS NULL THEN NULL WHEN last_line IS NULL OR line_id > last_line THEN 0"
        " WHEN line_id = last_line THEN last_pos + 1 END"
    )
    done = joined.withColumn("_first", F.expr(first)).withColumn(
        out, F.expr(scan.redact(column, options.with_(adaptive=True), ("threshold", "_first")))
    )
    return pseudonym.without_key(done).drop("threshold", "last_line", "last_pos", "_first")
