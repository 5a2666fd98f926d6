from functools import cache
from importlib import import_module

MODULES = ("post_queries", "comment_queries", "insight_queries", "page_queries", "table_queries")

_AUTHOR = "author_followers author_following author_statuses_count"
# Columns that the check SQL yields as 32-bit integers; results hold 64-bit ones.
NARROW = {
    "prj_01_flatten_post": _AUTHOR, "prj_01_flatten_quoted_post": _AUTHOR, "prj_02_posts_with_quotes": _AUTHOR,
    "prj_15_fact_posts": "author_followers", "agg_04_dim_authors": _AUTHOR, "qc_10_drop_funnel": "step_no",
    "prj_04_comment_tree": "reaction_count", "win_05_burst_flag": "reaction_count",
    "prj_16_fact_comments": "reaction_count", "ml_06_group_stance": "comment_level",
    "conv_02_post_contexts": "part parts", "prj_20_stance_levels": "comment_level",
    "llm_04_validate_insights": "mention_count", "fn_17_default_fields": "mention_count",
    "fn_18_intensity_rank": "weekly merging", "llm_02_parse_answers": "pos mention_count",
    "llm_02_parse_answers_strict": "pos mention_count", "llm_06_thread_insights": "year month",
    "llm_05_post_insights": "mention_count", "agg_18_quality_counters": "null_rows",
    "prj_08_group_feed": "comment_count", "prj_10_posts_without_feedback": "part",
    "snk_05_merge_twice": "mention_count", "inc_02_group_silver": "reaction_count",
    "ml_06_stance_job": "comment_level",
}


@cache
def load_cases() -> None:
    from threadloom.registry.core import widen

    for name in MODULES:
        import_module(f"threadloom.registry.{name}")
    for name, columns in NARROW.items():
        widen(name, columns.split())
