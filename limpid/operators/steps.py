"""The cleaning steps one by one; each takes and returns a DataFrame.

Steps that need statistics of the data get them from the caller or compute them in one aggregate,
so the returned frame holds only literals and stays a narrow projection where no row is removed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.coerce import (
    any_of, col, equals_any, iso_date, nan_to_null, storage_of, strip, to_bool, to_date, to_number,
)
from limpid.functions.constants import CAST_LOSS_LIMIT
from limpid.functions.quantiles import exact_quantiles
from limpid.operators.sketches import approximate_quantiles
from limpid.operators.values import modes, number_moments
from limpid.session import count_rows
from limpid.sources.tables import ROW_ID


def storage(df: DataFrame, name: str) -> str:
    return storage_of(df.schema[name].dataType)


def replace_columns(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """One projection that replaces the given columns in place."""
    return df.select(*[(changes[c].alias(c) if c in changes else col(c)) for c in df.columns]) if changes else df


def fold_nan(df: DataFrame) -> DataFrame:
    changes = {f.name: nan_to_null(col(f.name), f.dataType) for f in df.schema
               if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return replace_columns(df, changes)


def strip_text(df: DataFrame) -> DataFrame:
    """Trim every text column."""
    return replace_columns(df, {
        f.name: strip(col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)})


def replace_sentinels(df: DataFrame, values: dict[str, list], coerce: bool = False) -> DataFrame:
    """Cells equal to one of the column's sentinel values become null."""
    return replace_columns(df, {
        name: F.when(~equals_any(col(name), listed, storage(df, name), coerce), col(name))
        for name, listed in values.items() if name in df.columns and listed})


def mark_sentinels_from(df: DataFrame, name: str, path: str, flag: str, coerce: bool = False) -> DataFrame:
    """Add ``flag``: the cell equals a value of a sentinel set that is kept as a table of doubles.

    The rule for text cells is that of a listed set: they match numbers only if ``coerce`` is set.
    Empty cells are spread over the join by salt, so they do not meet in one task.
    """
    if storage(df, name) == "object" and not coerce:
        return df.withColumn(flag, F.lit(False))
    values = df.sparkSession.read.parquet(path).select(F.col("value").alias("__sentinel"), F.lit(0).alias("__zero"))
    number = to_number(col(name), storage(df, name))
    salt = F.when(number.isNull(), F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(1_000)).cast("int")).otherwise(0)
    joined = df.join(values, (number == F.col("__sentinel")) & (salt == F.col("__zero")), "left")
    return joined.select(*[col(c) for c in df.columns], F.col("__sentinel").isNotNull().alias(flag))


def replace_sentinels_from(df: DataFrame, name: str, path: str, coerce: bool = False) -> DataFrame:
    """As ``replace_sentinels`` for a sentinel set too long for a literal list."""
    marked = mark_sentinels_from(df, name, path, "__listed", coerce)
    return replace_columns(marked, {name: F.when(~F.col("__listed"), col(name))}).drop("__listed")


def cast_counts(c: Column, kind: str) -> dict[str, Column]:
    """Counts that decide whether a column may be cast to a number."""
    number = to_number(c, kind)
    whole = number.isNotNull() & c.try_cast("bigint").isNotNull() & ~c.contains(".") if kind == "object" else F.lit(False)
    return {"rows": F.count(F.lit(1)), "filled": F.count(c), "numbers": F.count(number), "whole": F.count_if(whole)}


def cast_is_safe(filled: int, numbers: int, limit: float = CAST_LOSS_LIMIT) -> bool:
    """A cast to a number may turn at most ``limit`` of the filled cells into null."""
    return filled == 0 or (filled - numbers) / filled <= limit


def cast_expression(c: Column, kind: str, target: str, exact_integers: bool = False) -> Column:
    """The column cast to a plan type; cells that do not fit become null. Dates become ISO text."""
    if target in ("int", "float"):
        if kind in ("int", "float") or kind == "timestamp":
            return c
        if kind == "object" and exact_integers:
            return c.try_cast("bigint")
        return to_number(c, kind)
    if target == "date":
        return iso_date(to_date(c, kind))
    if target == "bool":
        return to_bool(c, kind)
    return c


def fill_statistics(df: DataFrame, strategies: dict[str, str], approx: bool = False) -> dict[str, dict]:
    """Mean, median or mode of the columns to fill, with their null counts.

    One scan serves all columns; medians add the bounded-memory quantile search and modes
    one count of values. ``nulls`` counts cells that are null after coercion to a number. With
    ``approx`` medians come from one scan into sketches.
    """
    numeric = {n: s for n, s in strategies.items() if s in ("median", "mean")}
    expressions = {n: to_number(col(n), storage(df, n)) for n in numeric}
    found = number_moments(df, dict(enumerate(expressions.values())))
    rows = count_rows(df) if numeric else 0
    out: dict[str, dict] = {}
    ranges = {}
    for i, name in enumerate(numeric):
        m = found.get(i)
        out[name] = {"nulls": rows - (m.n if m else 0), "value": m.mean if m else None}
        if numeric[name] == "median" and m:
            ranges[name] = (m.n, m.low, m.high)
    # a median is only needed where a cell is empty
    ranges = {n: r for n, r in ranges.items() if out[n]["nulls"]}
    wanted = {n: expressions[n] for n in ranges}
    medians = approximate_quantiles(df, wanted, [0.5]) if approx else exact_quantiles(df, wanted, ranges, [0.5])
    for name in ranges:
        out[name]["value"] = medians.get(name, {}).get(0.5)

    by_type: dict[str, list[str]] = {}
    for name, s in strategies.items():
        if s == "mode":
            by_type.setdefault(df.schema[name].dataType.simpleString(), []).append(name)
            out[name] = {"value": None}
    for names in by_type.values():
        for slot, value in modes(df, {i: col(n) for i, n in enumerate(names)}).items():
            out[names[slot]]["value"] = value
    return out


def fill_expression(df: DataFrame, name: str, strategy: str, stats: dict | None = None, value=None) -> Column | None:
    """The filled column, or None when the step leaves it alone."""
    c, kind = col(name), storage(df, name)
    if strategy in ("median", "mean"):
        x = to_number(c, kind)
        if kind in ("int", "float") and not stats["nulls"]:
            return None
        number = stats["value"]
        return x if number is None else F.coalesce(x, F.lit(float(number)))
    if strategy == "mode":
        return None if stats["value"] is None else F.coalesce(c, F.lit(stats["value"]))
    if strategy == "fill" and value is not None:
        return _fill_literal(c, kind, value)
    return None


def _fill_literal(c: Column, kind: str, value) -> Column:
    """A literal of another type than the column turns the column into text."""
    if isinstance(value, bool):
        value = int(value) if kind in ("int", "float") else value
    if kind == "int" and isinstance(value, (int, float)):
        whole = float(value).is_integer()
        return F.coalesce(c, F.lit(int(value))) if whole else F.coalesce(c.cast("double"), F.lit(float(value)))
    if kind == "float" and isinstance(value, (int, float)):
        return F.coalesce(c.cast("double"), F.lit(float(value)))
    if kind == "bool" and isinstance(value, bool):
        return F.coalesce(c, F.lit(value))
    if kind in ("int", "float") and isinstance(value, str):
        try:
            return _fill_literal(c, kind, float(value)) if math.isfinite(float(value)) else c
        except ValueError:
            pass
    return F.coalesce(c.cast("string"), F.lit(str(value)))


def drop_null_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Remove rows with a null in any of the columns, all in one filter."""
    return df.filter(~any_of([col(n).isNull() for n in names])) if names else df


def winsorise(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip to the fences. Nulls stay null; the column becomes double, as the fences are."""
    changes = {}
    for name, (lower, upper) in fences.items():
        x = to_number(col(name), storage(df, name))
        changes[name] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lower))), F.lit(float(upper))))
    return replace_columns(df, changes)


def remove_outliers(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Remove rows outside any of the fences; rows without a number stay."""
    out = []
    for name, (lower, upper) in fences.items():
        x = to_number(col(name), storage(df, name))
        out.append(F.coalesce((x < float(lower)) | (x > float(upper)), F.lit(False)))
    return df.filter(~any_of(out)) if out else df


def scale_statistics(df: DataFrame, kinds: dict[str, str]) -> dict[str, tuple[float, float]]:
    """(offset, divisor) per column to scale; constant columns are left out."""
    found = number_moments(df, {i: col(n).cast("double") for i, n in enumerate(kinds)})
    out = {}
    for i, (name, kind) in enumerate(kinds.items()):
        m = found.get(i)
        if m is None:
            continue
        if kind == "min_max" and m.high != m.low:
            out[name] = (m.low, m.high - m.low)
        elif kind == "z_score" and m.std_pop > 0:
            out[name] = (m.mean, m.std_pop)
    return out


def scale(df: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    return replace_columns(df, {
        name: (col(name).cast("double") - F.lit(a)) / F.lit(b) for name, (a, b) in parameters.items()})


def min_max_scale(df: DataFrame, names: list[str]) -> DataFrame:
    return scale(df, scale_statistics(df, dict.fromkeys(names, "min_max")))


def z_score_scale(df: DataFrame, names: list[str]) -> DataFrame:
    return scale(df, scale_statistics(df, dict.fromkeys(names, "z_score")))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    names = {old: new for old, new in names.items() if old in df.columns and new}
    final = [names.get(c, c) for c in df.columns if c != ROW_ID]
    if len(set(final)) != len(final):
        raise ValueError(f"renaming gives repeated column names: {sorted(n for n in final if final.count(n) > 1)}")
    return df.withColumnsRenamed(names) if names else df
