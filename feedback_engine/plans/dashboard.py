"""The dashboard: every key with the queries that fill it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedback_engine.plans import catalogue, views
from feedback_engine.sources.dims import monthly_players

Q = catalogue.QUERIES
Maker = Callable[[SparkSession, str], DataFrame]


def _side(name: str, side: str) -> Maker:
    return lambda spark, d: Q[name](spark, d).filter(f"sentiment = '{side}'").drop("sentiment")


def _static(df: Callable[[SparkSession], DataFrame]) -> Maker:
    return lambda spark, d: df(spark)


KEYS: dict[str, Maker] = {
    "overview": Q["overview_stats"],
    "category_rankings": Q["category_rankings"],
    "season_health": Q["season_health"],
    "season_categories": Q["season_top_tags"],
    "seasons_meta": _static(views.seasons),
    "monthly_timeline": Q["monthly_timeline"],
    "daily_timeline": Q["daily_timeline"],
    "daily_cats": Q["daily_top_tags"],
    "playtime_data": Q["bracket_profile"],
    "playtime_order": lambda spark, d: Q["bracket_profile"](spark, d).select("place", "bracket"),
    "cat_playtime_neg": _side("tag_bracket_heatmap", "negative"),
    "cat_playtime_pos": _side("tag_bracket_heatmap", "positive"),
    "cat_season_pt_neg": _side("cat_season_bracket", "negative"),
    "cat_season_pt_pos": _side("cat_season_bracket", "positive"),
    "cohort_data": Q["cohort_matrix"],
    "regional": Q["regional_profile"],
    "top_reviews": Q["top_records"],
    "recurring_problems": Q["recurring_tags"],
    "comparisons": Q["topic_comparison"],
    "trends": Q["trending_fixed"],
    "trend_issues": Q["trend_top_issues"],
    "season_diffs": Q["season_diffs"],
    "regional_deviation": Q["regional_deviation"],
    "category_correlations": Q["tag_cooccurrence"],
    "issues_by_month": Q["issues_by_month"],
    "lang_top_issues": Q["lang_tag_issues"],
    "top_issues": Q["top_issues"],
    "issues_by_season": Q["issues_by_season"],
    "entity_tracking": Q["entity_tracking"],
    "entity_issues": Q["entity_top_issues"],
    "entity_classes": Q["dim_entity_flatten"],
    "issue_stats": Q["issue_stats"],
    "category_issues": Q["category_issues"],
    "issue_playtime": Q["issue_bracket_dist"],
    "issue_samples": Q["stratified_sample"],
    "patch_impact": Q["patch_impact"],
    "player_count": _static(monthly_players),
    "playtime_tags": Q["bracket_top_tags"],
    "cohort_tags": Q["cohort_top_tags"],
    "regional_health": Q["regional_health"],
    "comparison_totals": Q["topic_totals"],
    "comparison_examples": Q["topic_examples"],
    "issue_playtime_by_season": Q["issue_season_bracket_dist"],
    "extraction_stats": Q["extraction_stats"],
    "extraction_entities": Q["extraction_entities"],
    "season_references": Q["season_references"],
    "hc": Q["hc_overlay"],
    "hc_overview": Q["hc_overview"],
    "hc_category_rankings": Q["hc_category_rankings"],
    "hc_season_categories": Q["hc_season_top_tags"],
    "hc_monthly_timeline": Q["hc_monthly_timeline"],
}


def dashboard(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A result for each key; write them with sinks.writers.dashboard."""
    return {key: make(spark, d) for key, make in KEYS.items()}
