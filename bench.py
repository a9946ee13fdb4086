"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores.
The generated corpus is written once beforehand, as an archive would be
unpacked before anyone queries it; that time is reported on its own.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "t2_code_lines",
    "t7_direct_matches",
    "t9_t10_t11_line_usages",
    "t12_t14_column_usages",
    "t7_t14_usages_large_dictionary",
    "p6_db_columns",
    "p9_field_columns",
    "r1_usage_detail",
    "r2_column_summary",
    "r5_project_list",
    "r17_components_of_tables",
    "r24_component_sources",
    "g1_region_tree",
    "g4_first_visits",
    "g4_cycles_on_paths",
    "g5_table_lineage",
    "g8_s11_nested_json",
    "g11_table_file_edges",
    "c2_batches",
    "d1_purge_projects",
]


def main() -> None:
    from weftline.plans import trace_queries
    from weftline.plans.all_queries import QUERIES
    from weftline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=cores, app="weftline-bench")
    spark.sparkContext.setLogLevel("ERROR")

    begin = time.time()
    trace_queries.corpus_entries(spark, sf_dir).count()
    setup = time.time() - begin

    seconds = {}
    for name in HEADLINE:
        begin = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "queries": seconds,
                "corpus_setup": round(setup, 2),
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
