"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and is then timed once, written to a sink that reads
every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "scan_report", "agg8_atomic_scan", "agg6_composite_levels", "agg13_file_risk", "agg10_import_findings", "agg15_directory_rollup",
    "agg18_findings_graph", "agg23_full_diff", "agg28_composite_precision", "agg31_container_guard", "ext2_string_kind", "ext14_decode_layers",
    "join1_exact_patterns", "join3_literal_then_regex", "join8_offset_section", "met1_text_lines", "met2_char_distribution", "met10_string_metrics",
    "met15_identifier_metrics", "met17_function_metrics", "prd2_raw_regex", "prd15_import_combination", "win1_near_lines", "win4_findings_cap",
    "cat2_same_pattern", "cat39_dangling_references", "man1_script_findings", "srt1_rename_list",
)


def main() -> None:
    from ruleloom.plans import QUERIES
    from ruleloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        times[name] = round(run(name), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
