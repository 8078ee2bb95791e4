"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusops.plans.queries import QUERIES  # noqa: E402
from corpusops.session import build_session  # noqa: E402

HEADLINE = [
    "a01_validation_summary",
    "p05_row_errors",
    "a07_vocab_size",
    "a11_profile",
    "o01_split_assign",
    "o07_epoch_order",
    "f02_normalize_encode",
    "t01_word_freq",
    "t04_char_vocab",
    "t05_encode_char",
    "a16_token_report",
    "j04_context_pairs",
    "w02_prefix_mean",
    "w01_best_so_far",
    "f12_pad_batch",
    "st2_stream_validate",
    "t02_bpe_merges",
    "t03_unigram",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths and the Python workers before the clock runs.
    for name in ("a03_task_distribution", "f02_normalize_encode"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
