"""The same plans on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import baseline as bl
from ..operators.redaction import redact_lines
from ..options import Options
from ..sources.folders import join_small, written
from ..sources.lines import numbered, spread


def redact_stream(stream: DataFrame, options: Options, column: str = "line", out: str = "redacted") -> DataFrame:
    """Redact a streaming line table. Row-local: no state store, no watermark."""
    return redact_lines(stream, options, column, out)


def write_stream(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append to parquet, exactly once through the checkpoint."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def numbered_stream(raw: DataFrame, options: Options, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """``lines.from_text_stream`` → redacted lines with their ids, one folder per batch, which a batch run again replaces."""

    def step(batch: DataFrame, batch_id: int) -> None:
        done = redact_lines(numbered(batch), options).drop("line")
        done.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


STATE = "source STRING, samples ARRAY<DOUBLE>, n BIGINT, threshold DOUBLE, ready BOOLEAN"


def _state_path(folder: str, batch_id: int) -> str:
    return f"{folder}/state/{batch_id}"


def baseline_state(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The baselines after a batch: one row per source; before the first batch there is none."""
    if batch_id < 0:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(_state_path(folder, batch_id))


def next_state(old: DataFrame, fresh: DataFrame, options: Options) -> DataFrame:
    """``old`` with the fresh samples (``source, rank, score``) added, no more than each source still needs.

    A source that becomes ready keeps its limit and drops its samples; nothing changes it from then on.
    """
    n = options.adaptive_samples
    new = fresh.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("new"))
    scored = F.transform("new", lambda x: x["score"])
    every = F.slice(F.concat(F.coalesce("samples", F.array().cast("array<double>")), scored), 1, n)
    grown = new.join(old, "source", "left").where("ready IS NULL OR NOT ready").select("source", every.alias("samples"))
    mean = F.expr("aggregate(samples, 0D, (s, x) -> s + x) / size(samples)")
    spread = F.expr("sqrt(aggregate(samples, 0D, (s, x) -> s + (x - mean) * (x - mean)) / size(samples))")
    ready = F.size("samples") >= n
    learnt = grown.withColumn("mean", mean).select(
        "source", F.when(~ready, F.col("samples")).alias("samples"), F.size("samples").cast("bigint").alias("n"),
        F.when(ready, F.col("mean") + 2 * spread).alias("threshold"), ready.alias("ready"),
    )
    return old.join(learnt.select("source"), "source", "left_anti").select(learnt.columns).unionByName(learnt)


def reset_sources(spark: SparkSession, folder: str, batch_id: int, *sources: str) -> None:
    """Forget the baselines of some sources (all, if none is named) as they stood after ``batch_id``, the last batch.

    For a stopped stream: the next batch starts to learn them anew.
    """
    state = baseline_state(spark, folder, batch_id)
    kept = state.where(~F.col("source").isin(*sources)) if sources else state.where("false")
    rows = written(kept, "reset")  # the folder it comes from is written over
    rows.write.mode("overwrite").parquet(_state_path(folder, batch_id))


def adaptive_stream(
    stream: DataFrame, options: Options, folder: str, trigger: dict | None = None
) -> StreamingQuery:
    """Redact ``source, line_id, line`` with running baselines per source.

    Each batch reads the state that the batch before it left, one compact row per source, and leaves
    its own: the scores gathered so far, or, once they are enough, the limit for good. Sources
    that are ready are not sampled again, and no batch looks further back than one. All writes of a batch replace
    its own folders and read those of the batch before, so a batch that runs again writes the same again.

    A source that was ready before the batch has its limit from the first line on, one that becomes ready from the
    leaf after the sample that completes it; places count inside the batch. Lines without a source keep the static limit.
    """
    n = options.adaptive_samples

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = baseline_state(spark, folder, batch_id - 1)
        rows = spread(written(batch, "batch"))
        settled = written(old.where("ready").select("source", "threshold"), "settled")
        learning = join_small(rows, settled, "source").where("threshold IS NULL").drop("threshold")
        have = old.where("NOT ready").select("source", F.col("n").alias("have"))
        needed = F.col("rank") + F.coalesce("have", F.lit(0)) <= n
        fresh = written(bl.samples(learning, options).join(have, "source", "left").where(needed).drop("have"), "fresh")
        next_state(old, fresh, options).write.mode("overwrite").parquet(_state_path(folder, batch_id))
        now = baseline_state(spark, folder, batch_id)
        before = settled.select("source", "threshold", F.lit(None).cast("bigint").alias("last_line"), F.lit(None).cast("int").alias("last_pos"))
        last = fresh.groupBy("source").agg(F.max(F.struct("line_id", "pos")).alias("last"))
        after = now.where("ready").join(settled.select("source"), "source", "left_anti").join(last, "source")
        after = after.select("source", "threshold", F.col("last.line_id").alias("last_line"), F.col("last.pos").alias("last_pos"))
        done = bl.redact_adaptive(rows, before.unionByName(after).withColumn("ready", F.lit(True)), options)
        done.write.mode("overwrite").parquet(f"{folder}/redacted/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
