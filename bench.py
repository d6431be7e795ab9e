"""Timing of the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores (default 8),
``BENCH_RUNS`` the timed runs per query after one warm-up (default 3; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsloom.registry.queries import queries  # noqa: E402
from newsloom.session import build_session  # noqa: E402

HEADLINE = (
    "weekly_label_share",
    "author_daily_activity",
    "exclusive_tag_sentiment",
    "term_sentiment_by_kicker",
    "multi_column_tag_by_origin",
    "prefix_tag_by_kicker",
    "market_articles_with_index",
    "frontier_append",
    "frontier_pending",
    "frontier_outcome",
    "article_extract",
    "dedup_second_oldest",
    "lexicon_score",
    "classify_extremes",
    "score_missing_merge",
    "word_tokens",
    "collected_articles",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "newsloom-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="newsloom-bench-"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total of per-query medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
