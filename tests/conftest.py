import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def redact(spark):
    """Redact a list of lines with given options, in order."""
    from hushmark.operators.redaction import redact_lines

    def run(lines, options):
        rows = [(i, line) for i, line in enumerate(lines)]
        df = redact_lines(spark.createDataFrame(rows, "i INT, line STRING"), options)
        return [r.redacted for r in df.orderBy("i").collect()]

    return run
