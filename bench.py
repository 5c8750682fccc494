"""Headline benchmark: prints one JSON line.

Redaction and findings of every document line and of one log line per order at
$BENCH_SF_DIR on local[$BENCH_CPUS]. Each query runs once to warm the JVM and is
then timed once, planning included, into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from hushmark import registry  # noqa: E402
from hushmark.operators import redaction, vocabulary  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

BENCH = {
    "red4_documents": registry.QUERIES["red4_documents"],
    "red4_texts": lambda s, d: redaction.redact_documents(registry.table(s, d, "documents").select("doc_id", "text"), registry.OPTIONS),
    "red4_logs": registry.QUERIES["red4_logs"],
    "red1_documents": registry.QUERIES["red1_documents"],
    "red6_logs": registry.QUERIES["red6_logs"],
    "tok1_documents": registry.QUERIES["tok1_documents"],
    "sco6_documents": registry.QUERIES["sco6_documents"],
    "safe_all": registry.QUERIES["safe_all"],
    "key1_logs": registry.QUERIES["key1_logs"],
    "url1_masked": registry.QUERIES["url1_masked"],
    "luh5_lines": registry.QUERIES["luh5_lines"],
    "jsn1_events": registry.QUERIES["jsn1_events"],
    "bas2_documents": registry.QUERIES["bas2_documents"],
    "evl1_logs": registry.QUERIES["evl1_logs"],
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name, run in BENCH.items():
        for _ in range(2):
            start = time.perf_counter()
            run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    sizes = {}
    for name, lines in (("documents", registry.doc_lines(spark, SF_DIR)), ("logs", registry.log_lines(spark, SF_DIR))):
        r = lines.selectExpr("count(*) AS n", "sum(octet_length(line)) AS b").first()
        sizes[name] = (r.n, r.b)
    words = vocabulary.vocabulary(registry.doc_lines(spark, SF_DIR).select("line")).selectExpr("sum(n) AS n", "count(*) AS d").first()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "documents_lines_per_sec": round(sizes["documents"][0] / times["red4_documents"]),
                "documents_mb_per_sec": round(sizes["documents"][1] / times["red4_documents"] / 1e6, 2),
                "logs_lines_per_sec": round(sizes["logs"][0] / times["red4_logs"]),
                "logs_mb_per_sec": round(sizes["logs"][1] / times["red4_logs"] / 1e6, 2),
                "tokens_per_distinct_token": round(words.n / words.d, 2),
            }
        )
    )


if __name__ == "__main__":
    main()
