"""Shared working folders for written tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL = 1 << 20  # rows of a narrow table that may be broadcast


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Every executor must reach it. Only a session on one machine may lack the setting; it gets
    a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="hushmark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/hushmark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, whatever happens to executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``rows`` left join a written table of one narrow row per key: broadcast while its counted rows are few,
    by a shuffle beyond."""
    few = small.count() <= SMALL
    return rows.join(small.hint("broadcast") if few else small.hint("shuffle_hash"), key, "left")
