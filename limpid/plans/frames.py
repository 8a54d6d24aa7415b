"""Plans as tables: stored plans opened up in Spark, and the rules as expressions over profiles of many tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.plans import rules as R

# The parts of a stored plan; values of any kind read as text, the report section stays as it is.
PLAN_DDL = (
    "columns map<string,struct<type:string,nullable:boolean,missing_values:struct<strategy:string,value:string,null_count:bigint>,"
    "normalize:string,rename_to:string,sentinel_values:array<string>,replace_sentinels:boolean,transform_hint:string,"
    "transform_code:string,sentinel_table:string,warnings:array<string>,note:string>>, "
    "duplicates struct<strategy:string,subset:array<string>,keep:string>, "
    "outliers map<string,struct<strategy:string,method:string,lower:double,upper:double,count:bigint,note:string>>, "
    "_metadata struct<generated_at:string,dq_score:double,issues_found:map<string,bigint>>, _eda variant"
)


def effective_plans(runs: DataFrame) -> DataFrame:
    """Every run with a plan: its columns, ``source`` and ``plan``, a struct of the parts of the plan that counts.

    That is the approved plan, or the generated one where none is approved. An approved plan without a
    report section has that of the generated plan. Text that is no plan counts as none.
    """
    parsed = runs.withColumns({name: F.from_json(f"plan_{name}", PLAN_DDL) for name in ("approved", "generated")})
    approved = F.col("approved.columns").isNotNull()
    merged = F.struct(*[
        F.when(approved, F.col(f"approved.{part}")).otherwise(F.col(f"generated.{part}")).alias(part)
        for part in ("columns", "duplicates", "outliers", "_metadata")], F.coalesce("approved._eda", "generated._eda").alias("_eda"))
    return (parsed.withColumn("source", F.when(approved, "approved").when(F.col("generated.columns").isNotNull(), "generated"))
            .withColumn("plan", merged).where("source is not null").drop("approved", "generated"))


def plan_columns(plans: DataFrame) -> DataFrame:
    """One row per run and column of ``effective_plans``: the rules of the column, with those for its outliers."""
    rows = plans.select("run_id", "source", F.col("plan.outliers").alias("outliers"), F.explode("plan.columns").alias("column", "rule"))
    out = F.try_element_at("outliers", F.col("column"))
    return rows.select(
        "run_id", "source", "column", "rule.type", "rule.nullable", F.col("rule.missing_values.strategy").alias("strategy"),
        F.col("rule.missing_values.value").alias("value"), F.col("rule.missing_values.null_count").alias("null_count"),
        F.when(F.col("rule.normalize") != "false", F.col("rule.normalize")).alias("normalize"), "rule.rename_to", "rule.sentinel_values",
        "rule.transform_code", out["strategy"].alias("outlier_strategy"), out["count"].alias("outlier_count"),
        out["lower"].alias("lower"), out["upper"].alias("upper"))


def carried_plans(runs: DataFrame) -> DataFrame:
    """(run_id, plan_generated): the plan text a run that is started again begins with, for every run that has one.

    Parts are carried as they are written; only the report section may come from the generated plan.
    """
    parts = [f.split(" ")[0] for f in PLAN_DDL.split(", ")] + ["custom_transforms"]
    ddl = ", ".join(f"{p} variant" for p in parts)
    parsed = runs.select("run_id", *[F.from_json(f"plan_{n}", ddl).alias(n) for n in ("approved", "generated")])
    approved = F.col("approved.columns").isNotNull()
    whole = F.struct(*[F.when(approved, F.col(f"approved.{p}")).otherwise(F.col(f"generated.{p}")).alias(p) for p in parts if p != "_eda"],
                     F.coalesce("approved._eda", "generated._eda").alias("_eda"))
    return parsed.where(approved | F.col("generated.columns").isNotNull()).select("run_id", F.to_json(whole).alias("plan_generated"))


# --- the rules over one row per column -----------------------------------------------------------

def _fill_rule(numbers_skewed: Column) -> Column:
    kind = F.col("detected_type")
    category = F.coalesce("cardinality_pct", F.lit(100.0)) < R.CATEGORY_PCT
    return (F.when(F.col("dependent"), "leave_null").when(F.col("null_pct") >= R.DROP_COLUMN_PCT, "drop_column")
            .when((kind == "numeric") & numbers_skewed, "median").when(kind == "numeric", "mean").when(kind == "bool", "mode")
            .when((kind == "string") & F.col("pattern").isNull() & category, "mode").otherwise("drop_row"))


def planned_columns(columns: DataFrame) -> DataFrame:
    """The rules for every column of any number of tables, in one pass.

    ``columns`` is the column frame of profiles (``TableProfile.column_frame``), with further columns
    ``total_rows`` and ``dependent`` (the gaps of the column depend on another one). All its other
    columns, such as the name of the table, stay. Added: type, nullable, strategy, fill_count, normalize,
    outlier_strategy, outlier_count.
    """
    stat = lambda name, missing: F.coalesce(F.col(f"stats.{name}"), F.lit(float(missing)))
    kind, n = F.col("detected_type"), F.coalesce("outliers.count", F.lit(0))
    spread = F.when(stat("std", 1) == 0, 1.0).otherwise(stat("std", 1))
    skewed = (n > 0) | (F.abs(stat("mean", 0) - stat("median", 0)) / spread > R.SKEW_LIMIT)
    needs = (F.col("null_count") > 0) | (F.col("invalid_count") > 0) | (F.size("sentinel_values") > 0)
    whole = lambda x: x == F.floor(x)
    whole_ends = whole(stat("min", 0)) & whole(stat("max", 0))
    plan_type = (F.when(kind.isin("bool", "date"), kind).when((kind == "numeric") & (F.col("storage_type") != "float") & whole_ends, "int")
                 .when(kind == "numeric", "float").when(F.col("pattern") == "date_iso", "date").otherwise("string"))
    large = (F.col("stats.max") - F.col("stats.min") > 0) & (F.greatest(F.abs("stats.min"), F.abs("stats.max")) > R.SCALE_LIMIT)
    share = n / F.col("total_rows")
    treated = (F.when(F.col("total_rows") < R.SMALL_TABLE, "winsorise").when(share < R.RARE_OUTLIERS, "remove")
               .when(share <= R.SOME_OUTLIERS, "winsorise").otherwise("keep"))
    found = (kind == "numeric") & (n > 0)
    return columns.withColumns({
        "type": plan_type, "nullable": needs, "strategy": F.when(needs, _fill_rule(skewed)),
        "fill_count": F.when(needs, F.col("null_count") + F.col("invalid_count") + F.col("sentinel_count")),
        "normalize": F.when((kind == "numeric") & large, F.when(n > 0, "z_score").otherwise("min_max")),
        "outlier_strategy": F.when(found, treated), "outlier_count": F.when(found, n)})
