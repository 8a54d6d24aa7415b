"""How many rows would a plan remove? Counted on the raw table, before anything is applied."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.coerce import any_of, col, equals_any, nan_to_null, storage_of, to_number
from limpid.operators.duplicates import mark_copies, row_key
from limpid.operators.steps import mark_sentinels_from
from limpid.plans.model import Plan
from limpid.sources.tables import ROW_ID, data_columns

DUPLICATE = "duplicate"
_LISTED = "__listed_"


@dataclass
class Strategies:
    """The choices whose effect is counted: per column, and for duplicates."""

    nulls: dict[str, str]
    outliers: dict[str, str]
    duplicates: str = "ignore"


def strategies_of(plan: Plan) -> Strategies:
    return Strategies(
        {n: r.missing_values.strategy for n, r in plan.columns.items() if r.missing_values},
        {n: o.strategy for n, o in plan.outliers.items()},
        plan.duplicates.strategy if plan.duplicates else "ignore")


def row_flags(df: DataFrame, plan: Plan, count_uncastable: bool = False) -> dict[str, Column]:
    """Flag per destructive operation of the plan, as expressions over the raw table.

    ``null_<column>``: null or a listed sentinel (with ``count_uncastable`` also cells the cast
    will turn null); ``outlier_<column>``: a number outside the stored fences.
    """
    flags = {}
    for name, rule in plan.columns.items():
        if name not in df.columns or rule.missing_values is None:
            continue
        kind = df.schema[name].dataType
        c, storage = nan_to_null(col(name), kind), storage_of(kind)
        flag = c.isNull()
        if rule.sentinel_values:
            flag = flag | equals_any(c, rule.sentinel_values, storage)
        if _LISTED + name in df.columns:
            flag = flag | col(_LISTED + name)
        if count_uncastable and rule.type in ("int", "float"):
            flag = flag | to_number(c, storage).isNull()
        flags[f"null_{name}"] = flag
    for name, rule in plan.outliers.items():
        if name in df.columns and rule.lower is not None and rule.upper is not None:
            x = to_number(nan_to_null(col(name), df.schema[name].dataType), storage_of(df.schema[name].dataType))
            flags[f"outlier_{name}"] = F.coalesce((x < rule.lower) | (x > rule.upper), F.lit(False))
    return flags


def _with_listed(df: DataFrame, plan: Plan) -> DataFrame:
    """Add a mark per column whose sentinel set is kept as a table."""
    for name, rule in plan.columns.items():
        if name in df.columns and rule.sentinel_table and rule.missing_values is not None:
            df = mark_sentinels_from(df, name, rule.sentinel_table, _LISTED + name)
    return df


def _flagged(df: DataFrame, plan: Plan, row_id: str | None) -> tuple[DataFrame, list[str]]:
    """(booleans per operation, key of the whole row and the row id, names of the booleans).

    Raw cells end here: everything that is shuffled afterwards is this narrow table.
    """
    columns = data_columns(df, row_id)
    marked = _with_listed(df, plan)
    flags = row_flags(marked, plan)
    kept = [col(row_id)] if row_id else []
    return marked.select(*kept, *[f.alias(n) for n, f in flags.items()], row_key(marked, columns).alias("__key")), list(flags)


def drop_flags(df: DataFrame, plan: Plan, row_id: str = ROW_ID) -> DataFrame:
    """One row per table row: its id and one boolean per operation. Written next to the raw table."""
    return mark_copies(_flagged(df, plan, row_id)[0], DUPLICATE, row_id)


def flag_patterns(df: DataFrame, plan: Plan, row_id: str | None = ROW_ID) -> DataFrame:
    """Rows per combination of flags: a small table that answers any choice of strategies.

    Full-row copies have equal flags, so the duplicate flag follows from the size of each group of
    copies: one of n is kept, n - 1 are flagged. No row ids are needed, and only flags and row keys
    are shuffled, combined before the shuffle.
    """
    row_id = row_id if row_id in df.columns else None
    narrow, names = _flagged(df, plan, row_id)
    flags = [col(n) for n in names]
    groups = narrow.groupBy("__key", *flags).agg(F.count(F.lit(1)).alias("__n"))
    counted = groups.select(*flags, F.stack(F.lit(2), F.lit(False), F.lit(1).cast("long"), F.lit(True), F.col("__n") - 1)
                            .alias(DUPLICATE, "rows")).filter(F.col("rows") > 0)
    return counted.groupBy(*flags, DUPLICATE).agg(F.sum("rows").alias("rows"))


def patterns_of_flags(flags: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """The same small table from stored per-row flags."""
    names = data_columns(flags, row_id)
    return flags.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias("rows"))


def drop_impact(patterns: DataFrame, chosen: Strategies) -> DataFrame:
    """One row: rows before, dropped and after, drops per kind, and drops saved by overlap."""
    active: dict[str, list[str]] = {"null": [], "outlier": [], DUPLICATE: []}
    for name in patterns.columns:
        if name.startswith("null_") and chosen.nulls.get(name[len("null_"):]) == "drop_row":
            active["null"].append(name)
        elif name.startswith("outlier_") and chosen.outliers.get(name[len("outlier_"):]) == "remove":
            active["outlier"].append(name)
        elif name == DUPLICATE and chosen.duplicates == "drop":
            active[DUPLICATE].append(name)
    rows = F.col("rows")

    def counted(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, rows)), F.lit(0)).cast("long")

    def total(names: list[str]) -> Column:
        out = F.lit(0).cast("long")
        for n in names:
            out = out + counted(col(n))
        return out

    dropped = counted(any_of([col(n) for names in active.values() for n in names]))
    parts = patterns.agg(
        F.coalesce(F.sum(rows), F.lit(0)).cast("long").alias("rows_before"), dropped.alias("rows_dropped"),
        total(active["null"]).alias("null_drops"), total(active["outlier"]).alias("outlier_drops"),
        total(active[DUPLICATE]).alias("duplicate_drops"))
    each = F.col("null_drops") + F.col("outlier_drops") + F.col("duplicate_drops")
    return parts.select(
        "rows_before", "rows_dropped", (F.col("rows_before") - F.col("rows_dropped")).alias("rows_after"),
        "null_drops", "outlier_drops", "duplicate_drops",
        F.greatest(F.lit(0).cast("long"), each - F.col("rows_dropped")).alias("overlap_saved"))
