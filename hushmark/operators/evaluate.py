"""Checks over redacted and labelled lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import repair

SECRET, SAFE, NOISE = "SECRET", "SAFE", "NOISE"
_CHANGED = "NOT line <=> redacted"
_FALSE_POSITIVE = f"label = '{SAFE}' AND {_CHANGED} AND contains(redacted, '[HIDDEN')"


def confusion(labelled: DataFrame, *by: str) -> DataFrame:
    """TP, TN, FP, FN and accuracy of ``line, redacted, label``; noise counts as negative."""
    tp, fn = f"label = '{SECRET}' AND {_CHANGED}", f"label = '{SECRET}' AND NOT ({_CHANGED})"
    counts = labelled.groupBy(*by).agg(
        F.expr(f"count_if({tp})").alias("tp"),
        F.expr(f"count_if(label <> '{SECRET}' AND NOT ({_FALSE_POSITIVE}))").alias("tn"),
        F.expr(f"count_if({_FALSE_POSITIVE})").alias("fp"),
        F.expr(f"count_if({fn})").alias("fn"),
    )
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return counts.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / total, 6))


def mistakes(labelled: DataFrame) -> DataFrame:
    """Leaks and false positives, with the line."""
    kind = F.when(F.expr(f"label = '{SECRET}' AND NOT ({_CHANGED})"), "leak").when(F.expr(_FALSE_POSITIVE), "false_positive")
    return labelled.withColumn("mistake", kind).where("mistake IS NOT NULL")


def golden_mismatches(actual: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """Lines that differ, are missing or are extra: ``got`` against ``want``."""
    joined = actual.select(*key, F.col("redacted").alias("got")).join(
        expected.select(*key, F.col("expected").alias("want")), list(key), "full_outer"
    )
    return joined.where("NOT got <=> want")


def json_breaks(redacted: DataFrame, *by: str) -> DataFrame:
    """How many JSON lines were read, and how many no longer parse after redaction."""
    json_lines = redacted.where("startswith(redacted, '{')")
    return json_lines.groupBy(*by).agg(
        F.count("*").alias("n_json"), F.expr("count_if(try_parse_json(redacted) IS NULL)").alias("n_broken")
    )


def output_properties(redacted: DataFrame, *by: str) -> DataFrame:
    """Invalid UTF-8 and output growth beyond three times the input plus 100 bytes."""
    return redacted.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.expr("count_if(NOT is_valid_utf8(redacted))").alias("n_invalid"),
        F.expr("count_if(octet_length(redacted) > 3 * octet_length(line) + 100)").alias("n_exploded"),
    )


def utf8_repairs(lines: DataFrame, *by: str, column: str = "line") -> DataFrame:
    """Lines with bad bytes per group, and their repaired text."""
    return lines.where(f"NOT is_valid_utf8({column})").select(*by, F.expr(repair(column)).alias("repaired"))


def volume(redacted: DataFrame, *by: str) -> DataFrame:
    """Lines and bytes before and after redaction; divided by a run's wall time this is its throughput."""
    return redacted.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sum(F.octet_length("line")).alias("n_bytes"), F.sum(F.octet_length("redacted")).alias("n_bytes_out")
    )


def throughput(lines: DataFrame, name: str = "throughput", column: str = "line"):
    """Observe rows and bytes while a job runs: (DataFrame, Observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return lines.observe(
        seen, F.count("*").alias("rows"), F.sum(F.octet_length(column)).alias("bytes")
    ), seen
