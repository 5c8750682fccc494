"""Work that is spread however a table lies in its files, and built input that stays whole in many files."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hushmark import registry
from hushmark.llm import sharding
from hushmark.sources import lines as line_source


def orders(path, n, **options):
    keys = list(range(n))
    pq.write_table(pa.table({"o_orderkey": keys, "o_orderpriority": [f"{k % 5}-LEVEL" for k in keys]}), path / "orders.parquet", **options)


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """Many splits of a file whose rows all lie in one row group: tasks got all rows or none."""
    n = 20 * line_source.TASK_ROWS
    orders(tmp_path, n, row_group_size=n)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = spark.read.parquet(str(tmp_path / "orders.parquet"))
        assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        held = registry.table(spark, str(tmp_path), "orders").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(r["count"] for r in held) == n
    assert max(r["count"] for r in held) <= 2 * line_source.TASK_ROWS


def test_key_patterns_find_their_keys(spark, tmp_path):
    orders(tmp_path, 38)
    found = {r.key: r.n for r in registry.QUERIES["key3_logs"](spark, str(tmp_path)).collect()}
    assert found == {"username": 38, "context_id": 38, "user": 38}


def documents(path):
    rows = [(i, "".join(f"{i} line {j}\n" for j in range(i % 7)) + "end", ("de", "en", None)[i % 3], "s") for i in range(60)]
    names = ("doc_id", "text", "lang", "source")
    pq.write_table(pa.table({n: list(v) for n, v in zip(names, zip(*rows))}), path / "documents.parquet")
    return rows


def test_a_log_goes_on_through_its_files(spark, tmp_path, monkeypatch):
    rows = documents(tmp_path)
    monkeypatch.setattr(registry.text_folder, "__defaults__", (500,))
    folder = registry.text_folder(spark, str(tmp_path), str(tmp_path / "made"))
    assert spark.read.text(folder).select(F.input_file_name()).distinct().count() > 3  # one would do for each language
    want = {}
    for _, text, lang, _ in rows:
        want.setdefault(lang or "__HIVE_DEFAULT_PARTITION__", []).extend(text.split("\n"))
    for name, column in (("src1_text", "line"), ("src2_text", "redacted")):
        got = registry.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted((r.lang, r.line_id, r[column]) for r in got) == sorted((k, i, x) for k, v in want.items() for i, x in enumerate(v))


def test_batches_are_read_from_many_files(spark, tmp_path, monkeypatch):
    """Three batches, none through a single file."""
    documents(tmp_path)
    folder = str(tmp_path / "work")
    monkeypatch.setattr(registry, "work_folder", lambda spark, name: folder)
    got = registry.QUERIES["bas5_stream"](spark, str(tmp_path)).collect()
    assert {(r.line_id >> 32) % 3 - r.batch for r in got} == {0} and len({r.line_id for r in got}) == len(got)
    read = spark.read.parquet(f"{folder}/in").selectExpr("line_id DIV 4294967296 % 3 AS part", "input_file_name() AS name")
    assert min(r["count"] for r in read.distinct().groupBy("part").count().collect()) > 1


def test_counts_come_in_one_job(spark):
    """However many partitions a shuffle has, a round of counting is not a job for each."""
    keys = spark.range(2000).selectExpr("xxhash64(id) AS high", "id AS low", "10L AS size").repartition(4)
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup("counted", "one round")
    try:
        found = sharding.counted(keys, [1 << 127])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(v[1] for v in found.values()) == 2000
    assert len(jobs) < 8
