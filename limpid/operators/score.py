"""Quality score, its dimensions, and issue counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limpid.functions.constants import SCORE_WEIGHTS
from limpid.operators.profile import TableProfile

ISSUE_KINDS = ("missing", "duplicates", "type_mismatches", "sentinel_values",
               "format_inconsistencies", "outliers", "malformed_rows")
SCORE_SCHEMA = (
    "overall double, completeness double, uniqueness double, validity double, consistency double, "
    "total_rows long, total_columns int, malformed_rows long, issues_found map<string,long>"
)


def overall_score(profile: TableProfile) -> float:
    return round(sum(getattr(profile, k) * w for k, w in SCORE_WEIGHTS.items()), 2)


def score_breakdown(profile: TableProfile) -> dict[str, float]:
    return {"overall": overall_score(profile)} | {k: round(getattr(profile, k), 2) for k in SCORE_WEIGHTS}


def count_issues(profile: TableProfile, approved_outliers: dict | None = None) -> dict[str, int]:
    """Issues by kind.

    After a plan was applied, pass its outlier rules: only outliers that were kept on purpose
    still count, since fences computed on the cleaned data are not comparable.
    """
    if approved_outliers is None:
        outliers = sum(c.outlier_count for c in profile.columns if c.detected_type == "numeric")
    else:
        outliers = sum((r.get("count") or 0) for r in approved_outliers.values() if r.get("strategy") == "keep")
    return {
        "missing": profile.missing_cells,
        "duplicates": profile.duplicate_rows,
        "type_mismatches": profile.invalid_cells,
        "sentinel_values": sum(c.sentinel_count for c in profile.columns),
        "format_inconsistencies": sum(1 for c in profile.columns if c.format_inconsistency),
        "outliers": outliers,
        "malformed_rows": profile.malformed_rows,
    }


def score_report(profile: TableProfile, approved_outliers: dict | None = None) -> dict:
    """Scores, issue counts and size of one profiled table."""
    return score_breakdown(profile) | {
        "issues_found": count_issues(profile, approved_outliers),
        "total_rows": profile.total_rows,
        "total_columns": profile.total_columns,
        "malformed_rows": profile.malformed_rows,
    }


def score_frame(spark: SparkSession, report: dict) -> DataFrame:
    return spark.createDataFrame([report], SCORE_SCHEMA)
