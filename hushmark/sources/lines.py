"""Line sources: every input becomes ``source, line_id, line``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from .folders import SMALL, join_small, written

LINE_SCHEMA = "source STRING, line_id BIGINT, line STRING"


def without_carriage_return(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


_BLOCK = ["file", "block"]


def _raw(reader, path: str) -> DataFrame:
    raw = reader.option("lineSep", "\n").load(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        without_carriage_return(F.col("value")).alias("line"),
    )


def numbered(raw: DataFrame) -> DataFrame:
    """``source, line_id, line`` of a table of ``file, block, line`` as files are read: ``line_id`` is the number of the line in its file, from 0.

    A large file is read in blocks. One pass counts the lines of each block, and the number of a line is those of the blocks
    before it in its file plus its place in its own block. So ids do not depend on how files are cut
    or dealt out, nor on the other files that are read with it.
    """
    placed = raw.withColumn("at", F.monotonically_increasing_id())
    blocks = placed.groupBy(*_BLOCK).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*_BLOCK, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    starts = written(starts, "blocks")
    few = starts.count() <= SMALL
    rows = placed.join(starts.hint("broadcast") if few else starts.hint("shuffle_hash"), _BLOCK)
    return rows.select(F.col("file").alias("source"), (F.col("at") + F.col("shift")).alias("line_id"), "line")


def from_text(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one row per line of any length; ``line_id`` counts the lines of each file, see ``numbered``."""
    return numbered(_raw(spark.read.format("text"), path))


def from_text_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Text files as an unbounded source: ``file, block, line``. A batch holds whole files, so ``numbered`` gives its lines
    the same ids as ``from_text`` does (``streaming.stream.numbered_stream``)."""
    reader: DataStreamReader = spark.readStream.format("text").options(**options)
    return _raw(reader, path)


def through_folders(rows: DataFrame) -> DataFrame:
    """``rows`` of ``numbered`` files, each with all its lines, numbered on from file to file of a folder by name, as a log goes
    on in its next file. Only a count per file is worked out and joined."""
    files = rows.groupBy("source").agg(F.count("*").alias("n"))
    folder = F.regexp_replace("source", "/[^/]*$", "")
    earlier = Window.partitionBy(folder).orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_"))
    placed = join_small(rows, written(starts, "files"), "source")
    return placed.withColumn("line_id", F.col("line_id") + F.col("before_")).select(rows.columns)


def from_table(df: DataFrame, source: Column, line_id: Column, text: Column) -> DataFrame:
    """A table that already holds one line per row."""
    return df.select(
        source.cast("string").alias("source"), line_id.cast("bigint").alias("line_id"), text.alias("line")
    )


def split_documents(df: DataFrame, doc_id: str, text: str, *keep: str) -> DataFrame:
    """Multi-line texts → lines with their number; blank lines stay."""
    return df.select(
        doc_id, *keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    )


def join_lines(lines: DataFrame, doc_id: str, line: str = "line") -> DataFrame:
    """Lines → texts again. Groups are single documents."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.col(line).alias("line"))))
    return lines.groupBy(doc_id).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text")
    )


TASK_ROWS = 1 << 15  # rows of a table that one task takes, about


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table dealt out so that the work on them uses all cores and no task grows with the table.

    A scan's tasks are cut by bytes, but a file's row group is read by one of them, however few bytes its rows take: of a
    narrow file with row groups of a million rows most tasks get nothing. So the rows of each task are counted, from
    the files' footers, and dealt out again, ``TASK_ROWS`` to a task, unless they already lie evenly."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id().alias("task")).groupBy("task").count()
    full, most, total = held.agg(F.count("*"), F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if full >= cores and most <= 2 * TASK_ROWS:
        return df
    return df.repartition(max(cores, -(-total // TASK_ROWS)))
