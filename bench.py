"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores. Each query is built
and run to the end of its plan, without moving rows to the driver; the better of two runs counts. A
query that needs a vocabulary or models fits them each time: vocabulary_topk is the fit of the vocabulary
alone, train_lr_metrics that of the models.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "flagship_goal_coverage",
    "canonicalise_cascade",
    "extract_skills",
    "extract_large_dictionary",
    "score_response",
    "learning_path",
    "score_with_models",
    "terms_bigrams",
    "vocabulary_topk",
    "tfidf_l2",
    "linear_score",
    "stored_models",
    "trained_models_used",
    "score_all_goals",
    "eval_confusion",
    "stratified_split",
    "train_lr_metrics",
    "health_rollup",
    "stream_score",
    "ext_partial_match",
]
RUNS = 2


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus if cpus != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {name: round(min(run(spark, name, sf_dir) for _ in range(RUNS)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir).removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
