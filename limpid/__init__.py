"""Data quality of tables of any size, as Spark jobs: profile, score, plan, clean."""

from limpid.operators.apply import apply_plan
from limpid.operators.impact import drop_flags, drop_impact, flag_patterns, strategies_of
from limpid.operators.profile import profile_table
from limpid.operators.score import score_report
from limpid.plans.model import Plan, PlanError
from limpid.plans.rules import build_plan
from limpid.run import analyse, clean
from limpid.sources.csv import read_csv
from limpid.sources.tables import read_parquet

__all__ = [
    "Plan", "PlanError", "analyse", "apply_plan", "build_plan", "clean", "drop_flags", "drop_impact",
    "flag_patterns", "profile_table", "read_csv", "read_parquet", "score_report", "strategies_of",
]
