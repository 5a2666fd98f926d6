"""Times headline queries: median of warm runs, one JSON line on stdout.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3)."""

from __future__ import annotations

import json
import os
import statistics
import time

from threadloom.registry import load_cases
from threadloom.registry.core import run
from threadloom.session import build_session

HEADLINES = (
    "agg_01_brand_daily", "inc_01_silver_posts", "agg_03_author_perf", "agg_04_dim_authors",
    "agg_15_brand_sentiment_overview", "agg_16_author_influence", "fn_01_clean_text", "ml_01_lexicon_sentiment",
    "ml_01_pandas_sentiment", "prj_04_comment_tree", "win_05_burst_flag", "agg_05_page_daily", "agg_06_issue_weekly",
    "agg_09_merge_insights", "agg_10_controversial_posts", "agg_11_entity_scorecard", "llm_02_parse_answers",
    "ml_05_video_stance", "ml_06_group_stance", "conv_01_build_threads", "conv_02_post_contexts",
    "prj_06_comment_threads", "prj_11_post_text", "qc_10_drop_funnel", "set_03_latest_by_key", "run_02_last_runs",
    "run_03_task_grid", "eval_04_confusion_matrix", "snk_05_merge_twice", "str_03_daily_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_cases()
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_median_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
