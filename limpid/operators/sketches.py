"""Quantiles and distinct counts from mergeable sketches, with stated bounds of their error.

One scan gives one row per column, or per column and part of the table (a file, a day), each with a
KLL sketch of its numbers and an HLL sketch of its values. Rows of parts can be stored and merged at
any time, so a table that grows by files is summed up without reading old files again. The
exact statistics of ``profile_table`` stay the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.coerce import cell_text, col, nan_to_null, storage_of, to_number
from limpid.operators.values import unpivot_cells
from limpid.sources.tables import ROW_ID, data_columns

# size of the KLL sketches and base-2 logarithm of the buckets of the HLL sketches
KLL_SIZE = 1_000
HLL_BITS = 14


def rank_error(size: int = KLL_SIZE) -> float:
    """Published bound of a KLL sketch: with 99 % confidence a quantile's rank is off by at most this share of the values."""
    return 2.296 / size ** 0.9021


def distinct_error(bits: int = HLL_BITS) -> float:
    """Three published standard errors of merged HLL sketches, as a share of the true number."""
    return 3 * 1.04 / 2 ** (bits / 2)


def column_sketches(df: DataFrame, part: Column | None = None, columns: list[str] | None = None, row_id: str | None = ROW_ID,
                    size: int = KLL_SIZE, bits: int = HLL_BITS) -> DataFrame:
    """One row per column, or per ``part`` and column, in one scan.

    Columns: part (if given), column, filled, numbers, low, high, quantiles (KLL of the cells that are
    numbers), distinct (HLL of all filled cells). NaN is a gap; a cell of text counts as a number if
    it reads as one. Columns and parts without a filled cell are absent. Cells are combined per
    task, so what is shuffled is a few sketches per task.
    """
    names = columns or data_columns(df, row_id)
    cells = []
    for slot, name in enumerate(names):
        kind = df.schema[name].dataType
        raw, storage = nan_to_null(col(name), kind), storage_of(kind)
        value = raw + 0.0 if storage == "float" else raw
        # 0.0 and -0.0 are one value
        cells += [F.lit(slot), to_number(raw, storage), cell_text(value, storage)]
    extra = [part.alias("part")] if part is not None else []
    long = df.select(*extra, F.stack(F.lit(len(names)), *cells).alias("slot", "number", "value")).where("value is not null")
    keys = ["part"] if part is not None else []
    found = long.groupBy(*keys, "slot").agg(
        F.count("value").alias("filled"), F.count("number").alias("numbers"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.kll_sketch_agg_double("number", size).alias("quantiles"), F.hll_sketch_agg("value", bits).alias("distinct"))
    return found.select(*keys, F.get(F.array(*[F.lit(n) for n in names]), F.col("slot")).alias("column"),
                        "filled", "numbers", "low", "high", "quantiles", "distinct")


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One row per column from rows of parts, however they came about."""
    return sketches.groupBy("column").agg(
        F.sum("filled").alias("filled"), F.sum("numbers").alias("numbers"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def sketched_quantiles(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """(column, p, value): a value that occurs, whose rank is within ``rank_error`` of p."""
    found = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))).alias("value"))
                      for p in probabilities])
    return sketches.where("numbers > 0").select("column", F.explode(found).alias("q")).select("column", "q.p", "q.value")


def sketched_distinct(sketches: DataFrame) -> DataFrame:
    """(column, filled, estimate): distinct values, off by at most ``distinct_error`` of their number."""
    return sketches.select("column", "filled", F.hll_sketch_estimate("distinct").alias("estimate"))


def approximate_quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float],
                          size: int = KLL_SIZE) -> dict[str, dict[float, float]]:
    """``{name: {p: value}}`` of double expressions, in one scan whatever their distribution; columns without a number are absent."""
    if not columns:
        return {}
    names = list(columns)
    sketched = unpivot_cells(df, dict(enumerate(columns.values()))).groupBy("slot").agg(F.kll_sketch_agg_double("value", size).alias("s"))
    picked = sketched.select("slot", *[F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probabilities)])
    return {names[r.slot]: {p: r[f"q{i}"] for i, p in enumerate(probabilities)} for r in picked.collect()}
