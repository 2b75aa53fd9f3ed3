"""Time the headline queries and print one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times (default 1); the median counts. The
whole result is computed and thrown away (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelkit.plans import QUERIES  # noqa: E402
from labelkit.session import build_session  # noqa: E402

HEADLINE = [
    "moderation_report",
    "classification_report",
    "evaluate_candidates",
    "multilabel_prf",
    "prediction_summary",
    "split_stratified",
    "split_three_way",
    "global_rank",
    "cap_per_group",
    "build_dataset",
    "taxonomy_inner",
    "label_counts",
    "parse_category_line",
    "explode_prompts",
    "sft_triples",
    "loss_mask",
    "preference_pairs",
    "fix_length",
    "zscore_array",
    "open_set_label",
    "topk_classes",
    "score_linear",
    "rule_verdict",
    "rule_repeat_hour",
    "dup_exact_across",
    "dup_near",
    "rule_mentions",
    "stream_label_counts",
    "stream_repeat_state",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "labelkit-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
