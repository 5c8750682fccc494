"""Helpers the operators share: written intermediates, joins on hot keys, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAVY = 1024  # a key is heavy above 1/HEAVY of all rows, so at most HEAVY keys are


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may lack the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/hushmark/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, clear: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. Survives lost executors.

    With ``clear`` Spark deletes the write's shuffle files as soon as it ends, since the
    table stands for them from then on.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    if clear:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left join ``groups`` (one row per key, ``size`` rows of each key).

    Keys that hold more than ``total / HEAVY`` rows are at most ``HEAVY``: they are
    broadcast, so no hot key is ever shuffled. All other keys meet in a shuffle join
    whose largest group is bounded by the same share.
    """
    heavy_one = F.col(size) * HEAVY > F.lit(total)
    heavy, light = groups.where(heavy_one), groups.where(~heavy_one)
    kept = [c for c in groups.columns if c != key]
    tagged = rows.join(F.broadcast(heavy.withColumn("hot_", F.lit(True))), key, "left")
    hot = tagged.where("hot_").drop("hot_")
    rest = tagged.where("hot_ IS NULL").drop("hot_", *kept)
    return hot.unionByName(rest.join(light, key, "left"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def row_key(doc_id: str, text: str):
    """Two columns of 64 bits that identify a row by id and text, null-safe: among 10 billion rows
    two different ones agree in both with a chance of about one in 10 ** 18."""
    return F.xxhash64(F.col(doc_id), F.col(text)), F.xxhash64(F.lit("second"), F.col(text), F.col(doc_id))


def only(docs: DataFrame, stays: DataFrame, doc_id: str, text: str, one: bool = True) -> DataFrame:
    """Rows of ``docs`` whose ``row_key`` is in ``stays`` (``k1, k2``); with ``one``, one row of each id and text."""
    k1, k2, nth = fresh(docs, "k1_"), fresh(docs, "k2_"), fresh(docs, "nth_")
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(doc_id, text), strict=True)))
    kept = keyed.join(stays.select(F.col("k1").alias(k1), F.col("k2").alias(k2)), [k1, k2], "left_semi")
    if not one:
        return kept.select(*docs.columns)
    ranked = kept.withColumn(nth, F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(1))))
    return ranked.where(F.col(nth) == 1).select(*docs.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star rounds over written tables, until nothing
    changes; each edge is kept once, so a round costs one aggregation and one join.
    """
    now = written(_down(edges, a, b), "edges")
    seen = _print(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _down(_star(both, True), "u", "v")
        now, before = written(_down(_star(large, False), "u", "v"), "stars"), seen
        seen = _print(now)
        if seen == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _down(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()


def _print(df: DataFrame) -> tuple:
    """Fingerprint of a table: two tables with the same rows have the same one."""
    h = F.xxhash64("u", "v")
    return tuple(df.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h, "u"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each ``u`` to the smallest of them and ``u``: the larger
    neighbours, or, where all are smaller, those and ``u`` itself."""
    pairs = written(pairs, "pairs")
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n_"))
    joined = join_hot(pairs, least, "u", "n_", max(pairs.count(), 1))
    ends = (joined.where("v > u") if large else joined).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ends if large else ends.union(least.select("u", F.col("m").alias("v")))
