"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query: one warm-up, one measured run."""

import json
import os
import time

from pyspark.sql import SparkSession

from tokenloom.plans import queries

NAMES = ("pretokenize_gpt2", "pretokenize_cl100k", "count_ordinary_gpt2", "encode_ordinary", "piece_frequency", "tokens_by_lang_source")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "64k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        times = []
        for _ in range(2):
            began = time.time()
            queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(times[1], 3)
    size = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(octet_length(text)) n").first().n
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "text_bytes": size, "encode_mb_s": round(size / 1e6 / took["encode_ordinary"], 2)}))


if __name__ == "__main__":
    main()
