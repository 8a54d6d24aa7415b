"""Apply a plan: ten steps in a fixed order, each seeing the result of the one before.

 1 trim text            5 fill or drop missing   8 drop duplicates
 2 sentinels to null    6 recast integers        9 scale numbers
 3 custom transforms    7 treat outliers        10 rename
 4 cast to plan types

Statistics are collected at barriers: cast safety and transform damage before step 4, fill values
before step 5, null counts before step 6, scale parameters before step 9. Every barrier is a wide
aggregate over a projection of the source; what comes back are literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from limpid.functions.coerce import col
from limpid.operators import steps
from limpid.operators.duplicates import drop_duplicates
from limpid.operators.transforms import bind_transform, check_transform, damage_counts, damage_reason
from limpid.plans.model import Plan
from limpid.session import aggregate_in_groups, stage
from limpid.sources.tables import ROW_ID, data_columns


@dataclass
class Applied:
    """A cleaned frame and what happened on the way."""

    df: DataFrame
    skipped_casts: list[str] = field(default_factory=list)
    reverted_transforms: dict[str, str] = field(default_factory=dict)
    skipped_hints: list[str] = field(default_factory=list)
    unscaled: list[str] = field(default_factory=list)
    dropped_columns: list[str] = field(default_factory=list)


def apply_plan(df: DataFrame, plan: Plan, row_id: str | None = ROW_ID, coerce_sentinels: bool = False, approx: bool = False) -> Applied:
    """Cleaned frame for a plan. Plan columns that are not in the frame are skipped.

    ``coerce_sentinels`` also lets a number in a sentinel list match a text cell with that number.
    ``approx`` takes medians from sketches.
    """
    plan.checked()
    row_id = row_id if row_id in df.columns else None
    out = Applied(df)
    rules = {n: r for n, r in plan.columns.items() if n in df.columns and n != row_id}

    # 1-2
    df = steps.strip_text(steps.fold_nan(df))
    df = steps.replace_sentinels(
        df, {n: r.sentinel_values for n, r in rules.items() if r.sentinel_values and r.replace_sentinels},
        coerce_sentinels)
    for name, rule in rules.items():
        if rule.sentinel_table and rule.replace_sentinels:
            df = steps.replace_sentinels_from(df, name, rule.sentinel_table, coerce_sentinels)

    # 3
    df = _transform(df, rules, out)

    # 4
    parsed = [n for n, r in rules.items() if steps.storage(df, n) == "object" and r.type != "string"]
    df = _cast(df, rules, out)
    if parsed or any(r.transform_code for r in rules.values()):
        # text is parsed once; later passes and filters would otherwise parse it again each time
        df = stage(df, "typed")

    # 5
    strategies = {n: r.missing_values.strategy for n, r in rules.items() if r.missing_values}
    stats = steps.fill_statistics(df, {n: s for n, s in strategies.items() if s in ("median", "mean", "mode")}, approx)
    changes = {}
    for name, strategy in strategies.items():
        filled = steps.fill_expression(df, name, strategy, stats.get(name), rules[name].missing_values.value)
        if filled is not None:
            changes[name] = filled
    df = steps.replace_columns(df, changes)
    out.dropped_columns = [n for n, s in strategies.items() if s == "drop_column"]
    if out.dropped_columns:
        df = df.drop(*[col(n) for n in out.dropped_columns])
    dropped_on = [n for n, s in strategies.items() if s == "drop_row"]
    df = steps.drop_null_rows(df, dropped_on)

    # 6
    df = _recast_integers(df, rules)

    # 7
    clipped, removed = {}, {}
    for name, rule in plan.outliers.items():
        if name in df.columns and rule.lower is not None and rule.upper is not None:
            if rule.strategy in ("winsorise", "cap"):
                clipped[name] = (rule.lower, rule.upper)
            elif rule.strategy == "remove":
                removed[name] = (rule.lower, rule.upper)
    df = steps.remove_outliers(df, removed)
    df = steps.winsorise(df, clipped)

    # 8
    scaled = {n: r.normalize for n, r in rules.items() if r.normalize and n in df.columns}
    out.unscaled = [n for n in scaled if steps.storage(df, n) not in ("int", "float")]
    scaled = {n: k for n, k in scaled.items() if n not in out.unscaled}
    before_dedup = df
    dedup = plan.duplicates is not None and plan.duplicates.strategy == "drop"
    if dedup:
        df = drop_duplicates(df, plan.duplicates.subset or None, plan.duplicates.keep, row_id)

    # 9
    if scaled:
        source = df
        if dedup:
            if plan.duplicates.subset or "z_score" in scaled.values():
                # the statistics and the result both need the deduplicated rows: shuffle once
                source = df = stage(df, "deduplicated")
            else:
                # removing full copies changes neither minimum nor maximum
                source = before_dedup
        df = steps.scale(df, steps.scale_statistics(source, scaled))

    # 10
    out.df = steps.rename(df, {n: r.rename_to for n, r in rules.items() if r.rename_to})
    return out


def _transform(df: DataFrame, rules: dict, out: Applied) -> DataFrame:
    codes = {n: r.transform_code for n, r in rules.items() if r.transform_code}
    out.skipped_hints = [n for n, r in rules.items() if r.transform_hint and not r.transform_code]
    sound = {}
    for name, code in codes.items():
        ok, reason = check_transform(df.sparkSession, code, df.schema[name].dataType.simpleString())
        if ok:
            sound[name] = code
        else:
            out.reverted_transforms[name] = reason

    def counts(names: list[str]) -> dict:
        """Damage of several transforms in one pass over pairs of old and new cells."""
        paired = df.select(*[x for n in names for x in (col(n).alias(f"before:{n}"), col(n))])
        for n in names:
            paired = bind_transform(paired, n, sound[n])
        return aggregate_in_groups(paired, {
            f"{n}:{k}": c for n in names for k, c in damage_counts(col(f"before:{n}"), col(n)).items()})

    found: dict = {}
    if sound:
        try:
            found = counts(list(sound))
        except PySparkException:
            # one of them fails on some cell: find out which, keep the others
            for name in list(sound):
                try:
                    found |= counts([name])
                except PySparkException as e:
                    out.reverted_transforms[name] = f"{type(e).__name__}: {e}"
                    sound.pop(name)
    for name, code in sound.items():
        reason = damage_reason(found, f"{name}:", invented_counts=False)
        if reason:
            out.reverted_transforms[name] = reason
        else:
            df = bind_transform(df, name, code)
    return df


def _cast(df: DataFrame, rules: dict, out: Applied) -> DataFrame:
    guarded = [n for n, r in rules.items() if r.type in ("int", "float") and steps.storage(df, n) == "object"]
    found = aggregate_in_groups(df, {
        f"{n}:{k}": c for n in guarded for k, c in steps.cast_counts(col(n), "object").items()})
    changes = {}
    for name, rule in rules.items():
        kind, whole = steps.storage(df, name), False
        if name in guarded:
            rows, filled, numbers = (found[f"{name}:{k}"] for k in ("rows", "filled", "numbers"))
            if not steps.cast_is_safe(filled, numbers):
                out.skipped_casts.append(name)
                continue
            whole = rows == found[f"{name}:whole"]
        if rule.type != "string":
            changes[name] = steps.cast_expression(col(name), kind, rule.type, whole)
    return steps.replace_columns(df, changes)


def _recast_integers(df: DataFrame, rules: dict) -> DataFrame:
    """Integer columns that ended up as double or bool return to integers if no cell is empty."""
    names = [n for n, r in rules.items()
             if r.type == "int" and n in df.columns and steps.storage(df, n) in ("float", "bool")]
    if not names:
        return df
    unfit = aggregate_in_groups(df, {
        n: F.count_if(col(n).isNull() | (F.abs(col(n).cast("double")) >= 2.0 ** 63)) for n in names})
    return steps.replace_columns(df, {n: col(n).cast("bigint") for n in names if not unfit[n]})


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` and the number of its rows, counted by whatever reads all of it first."""
    counted = Observation()
    return df.observe(counted, F.count(F.lit(1)).alias("rows")), counted


def observed_rows(counted: Observation, df: DataFrame) -> int:
    """What ``counted`` saw; ``df`` is counted only if the optimiser found nothing in it to read."""
    found = counted.get.get("rows")
    return df.agg(F.count(F.lit(1))).first()[0] if found is None else found


def written_change_report(spark: SparkSession, rows_before: int, rows_after: int, before: list[str], after: list[str]) -> DataFrame:
    """``change_report`` of a table that was written, from counts taken on the way; no job is started."""
    gone = sorted(set(before) - set(after))
    return spark.createDataFrame([(rows_before, rows_after, rows_before - rows_after, gone)],
                                 "rows_before long, rows_after long, rows_dropped long, columns_removed array<string>")


def change_report(before: DataFrame, after: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    """Rows before and after, and the columns that are gone (renamed or dropped)."""
    gone = sorted(set(data_columns(before, row_id)) - set(data_columns(after, row_id)))
    first = before.agg(F.count(F.lit(1)).alias("rows_before"))
    second = after.agg(F.count(F.lit(1)).alias("rows_after"))
    # two single-row aggregates side by side
    return first.join(second, F.lit(True)).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_dropped"),
        F.array(*[F.lit(c) for c in gone]).cast("array<string>").alias("columns_removed"))
