"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores.
Each query is planned and run to the end without collecting its rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revtide.catalog import QUERIES  # noqa: E402
from revtide.session import local_session  # noqa: E402

HEADLINE = (
    "basic_stats",
    "author_ranking",
    "author_activity",
    "weekday_hour_pivot",
    "file_types",
    "dir_file_count",
    "dir_loc_others",
    "loc_trend",
    "author_loc_trend_all",
    "file_count_trend",
    "avg_loc_trend",
    "churn_by_day",
    "dir_loc_trend",
    "waste_effort",
    "bugfix_trend",
    "hot_files",
    "file_temperature",
    "revision_temperature",
    "revision_activity_index",
    "active_authors",
    "commit_gap_histogram",
    "commit_gap_stats",
    "revision_gaps",
    "word_frequency",
    "diff_line_counts",
    "inherit_copyfrom",
    "encode_paths",
    "expand_dir_copies",
    "author_file_edges",
    "cochange_edges_decayed",
    "coauthor_edges",
    "coauthor_matrix",
    "degree_centrality",
    "degree_over_time",
    "file_network",
    "connected_components",
    "closeness_centrality",
    "betweenness",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["path_scope"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
