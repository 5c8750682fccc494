"""Keyed-hash placeholders. Key material travels as columns, never as plan text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import Options

IPAD, OPAD = "hush_ipad", "hush_opad"
_SCHEMA = T.StructType([T.StructField(IPAD, T.BinaryType()), T.StructField(OPAD, T.BinaryType())])


def key_table(spark: SparkSession, options: Options) -> DataFrame:
    """One row: the two HMAC key blocks."""
    inner, outer = options.hmac_pads()
    return spark.createDataFrame([(bytearray(inner), bytearray(outer))], _SCHEMA)


def with_key(df: DataFrame, options: Options) -> DataFrame:
    """Attach the key blocks to every row: one broadcast row, no shuffle."""
    return df.join(F.broadcast(key_table(df.sparkSession, options)))


def without_key(df: DataFrame) -> DataFrame:
    return df.drop(IPAD, OPAD)


def hmac_hex(message: str) -> str:
    """HMAC-SHA256 of a string, as hex."""
    inner = f"unhex(sha2(concat({IPAD}, CAST({message} AS BINARY)), 256))"
    return f"sha2(concat({OPAD}, {inner}), 256)"


def placeholder(message: str) -> str:
    """``[HIDDEN:`` + the first six hex digits + ``]``."""
    return f"concat('[HIDDEN:', left({hmac_hex(message)}, 6), ']')"
