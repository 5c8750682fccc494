"""Exact dedup: digest runs merged along a tree of partition exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, only, partitions, row_key, written

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One small row per document: row number, id, length, and three digests of the normalised text."""
    norm = normalised(text)
    k1, k2 = row_key(doc_id, text)
    return docs.select(
        k1.alias("k1"), k2.alias("k2"),
        F.col(doc_id).alias("doc_id"),
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("n"),
        F.struct(F.unhex(F.sha2(norm, 256)).alias("sha"), F.octet_length(norm).alias("bytes"), F.xxhash64(norm).alias("xx")).alias("digest"),
    )


def merged_runs(rows: DataFrame, fan_in: int = 4) -> DataFrame:
    """``digest, best, size``: one row per digest, merged in rounds.

    ``fan_in ** rounds`` partitions each own a range of digests. In round r a
    partition sends every digest to the partition that differs from it in digit r
    of its number only, where that digit becomes the owner's; so each partition
    receives runs from ``fan_in`` partners, sorts them together and keeps one row
    per digest with the count and the best row so far. Equal digests scatter over
    partitions in the first rounds and are single rows before they meet, so no
    group of copies is ever gathered. Digests count as equal only if SHA-256,
    length and a second hash agree.
    """
    rounds = 1
    while fan_in**rounds < partitions(rows.sparkSession):
        rounds += 1
    n = fan_in**rounds
    owner = F.expr(f"CAST(CAST(conv(hex(substring(digest.sha, 1, 4)), 16, 10) AS BIGINT) * {n} DIV 4294967296 AS INT)")
    # most code points first, then the smallest id; rows without an id come last
    best = F.struct((-F.col("n")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    run = rows.select("digest", best.alias("best"), F.lit(1).cast("long").alias("size"), (F.spark_partition_id() % n).alias("run"))
    for step in range(rounds):
        unit = fan_in**step
        digit = lambda x: F.floor(x / unit) % fan_in
        run = run.withColumn("run", (F.col("run") + (digit(owner) - digit(F.col("run"))) * unit).cast("int"))
        run = run.repartitionById(n, "run").groupBy("run", "digest").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    return run.drop("run")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Which rows have equal texts after blanks are deleted, and which row of each group stays.

    Returns ``doc_id, uid, k1, k2, digest, keep_id, keep_uid, group_size, kept``, one row per
    document. Null text equals the empty text. The longest original (in code points)
    stays, then the smallest id, null ids last, then the first row in scan order; so of
    rows that repeat an id and a text exactly one is kept. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    rows = written(digests(docs, doc_id, text), "digests")
    groups = merged_runs(rows).where("size > 1").select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "size")
    groups = written(groups, "groups")
    found = join_hot(rows, groups, "digest", "size", max(rows.count(), 1))
    alone = F.col("size").isNull()
    return found.select(
        "doc_id", "uid", "k1", "k2", "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.col("uid")).otherwise(F.col("keep_uid")).alias("keep_uid"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they were."""
    return only(docs, exact_dedup(docs, doc_id, text).where("kept"), doc_id, text)
