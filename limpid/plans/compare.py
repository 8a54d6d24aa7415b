"""Difference of two plans as a table, and impact labels of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.plans.model import Plan

ABSENT = "—"
FIELDS = ("type", "fill", "normalize", "rename_to", "nullable", "transform_hint", "transform_code")
_FIELD_SCHEMA = "section string, name string, " + ", ".join(f"`{f}` string" for f in FIELDS)


def compare_tables(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, from, to): fields that differ between two tables with one row per key.

    A key on one side only gives a single row with field ``column``.
    """
    left = before.select(F.col(key).alias("k_a"), *[F.col(f).cast("string").alias("a_" + f) for f in fields])
    right = after.select(F.col(key).alias("k_b"), *[F.col(f).cast("string").alias("b_" + f) for f in fields])
    both = left.join(right, F.col("k_a") == F.col("k_b"), "full_outer")
    one_sided = F.col("k_a").isNull() | F.col("k_b").isNull()
    pairs = [x for f in fields for x in (F.lit(f), _shown("a_" + f), _shown("b_" + f))]
    presence = [F.lit("column"), F.when(F.col("k_a").isNull(), ABSENT).otherwise("present"),
                F.when(F.col("k_b").isNull(), "removed").otherwise("present")]
    shared = both.filter(~one_sided).select(
        F.col("k_a").alias(key), F.stack(F.lit(len(fields)), *pairs).alias("field", "from", "to"))
    single = both.filter(one_sided).select(
        F.coalesce("k_a", "k_b").alias(key), *[c.alias(n) for c, n in zip(presence, ("field", "from", "to"))])
    return shared.filter(F.col("from") != F.col("to")).unionByName(single)


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(ABSENT))


def _fill_text(rule) -> str:
    if rule is None:
        return ABSENT
    return f"fill: {rule.value}" if rule.strategy == "fill" else rule.strategy


def comparison_frame(spark: SparkSession, plan: Plan) -> DataFrame:
    """Fields of a plan that count as a change when they differ, one row per column."""
    rows = [(n, c.type, _fill_text(c.missing_values), str(c.normalize) if c.normalize else "none", c.rename_to,
             "yes" if c.nullable else "no", c.transform_hint, c.transform_code) for n, c in plan.columns.items()]
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"`{f}` string" for f in FIELDS))


def _duplicates(plan: Plan) -> list[tuple[str, str]]:
    d = plan.duplicates
    if d is None:
        return [("strategy", ABSENT)]
    return [("strategy", d.strategy), ("keep", d.keep if d.strategy == "drop" else ABSENT),
            ("subset", ", ".join(d.subset) or ABSENT)]


def compare_plans(spark: SparkSession, generated: Plan, applied: Plan) -> DataFrame:
    """(section, name, field, from, to) of all changes from the generated to the applied plan."""
    columns = compare_tables(
        comparison_frame(spark, generated), comparison_frame(spark, applied), "name", list(FIELDS)
    ).select(F.lit("columns").alias("section"), "name", "field", "from", "to")
    now = dict(_duplicates(applied))
    rows = [("duplicates", "", f, v, now.get(f, ABSENT)) for f, v in _duplicates(generated)]
    for name in dict.fromkeys([*generated.outliers, *applied.outliers]):
        rows.append(("outliers", name, "strategy", *[
            p.outliers[name].strategy if name in p.outliers else ABSENT for p in (generated, applied)]))
    rest = spark.createDataFrame(rows, "section string, name string, field string, `from` string, `to` string")
    return columns.unionByName(rest.filter(F.col("from") != F.col("to")))


def total_changes(changes: DataFrame) -> DataFrame:
    """Number of changed columns and outlier rules, plus one if the duplicate rule changed."""
    return changes.agg(
        (F.countDistinct(F.when(F.col("section") == "columns", F.col("name")))
         + F.countDistinct(F.when(F.col("section") == "outliers", F.col("name")))
         + F.countDistinct(F.when(F.col("section") == "duplicates", F.lit(1)))).alias("total_changes"))


def impact_labels(plan_rows: DataFrame) -> DataFrame:
    """Per column of a plan table the effect of its fill and outlier strategies in words."""
    n, s, o = F.col("null_count"), F.col("strategy"), F.col("outlier_strategy")
    count = F.coalesce(F.col("outlier_count"), F.lit(0))
    span = F.concat(F.lit("["), F.col("lower").cast("string"), F.lit("–"), F.col("upper").cast("string"), F.lit("]"))
    fill = (
        F.when(s == "drop_row", F.format_string("%s nulls → drop row", n))
        .when(s == "drop_column", F.lit("→ column removed"))
        .when(s == "fill", F.format_string("%s nulls → fill with %s", n, F.coalesce("fill_value", F.lit("?"))))
        .when(s.isin("mean", "median", "mode"), F.format_string("%s nulls → fill with %s", n, s))
        .when(s == "leave_null", F.format_string("%s nulls kept", n)))
    outlier = (
        F.when(o == "winsorise", F.format_string("%s → winsorize %s", count, span))
        .when(o == "cap", F.format_string("%s → cap to %s", count, span))
        .when(o == "remove", F.format_string("%s → remove rows", count))
        .when(o == "keep", F.format_string("%s outliers kept", count)))
    return plan_rows.select(
        "column", F.when(F.coalesce(n, F.lit(0)) > 0, fill).alias("fill_impact"), outlier.alias("outlier_impact"))
