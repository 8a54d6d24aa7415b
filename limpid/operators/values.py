"""Value counts of many columns at once: distinct counts, frequent values, modes, samples."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from limpid.functions.coerce import col, is_bool_like, is_sentinel_word, matches, to_date, to_number
from limpid.functions.constants import PATTERNS


# Characters of a cell beyond which its digest is grouped instead of its text.
LONG_CELL = 128


def unpivot_cells(df: DataFrame, cells: dict[int, Column], extra: list[Column] | None = None) -> DataFrame:
    """One row (slot, value, extra...) per non-null cell of the given expressions.

    ``stack`` stays in generated code, unlike array functions that take a lambda.
    """
    extra = extra or []
    stacked = [x for slot, c in cells.items() for x in (F.lit(slot), c)]
    return (
        df.select(*extra, F.stack(F.lit(len(cells)), *stacked).alias("slot", "value"))
        .filter(F.col("value").isNotNull())
    )


def number_moments(df: DataFrame, numbers: dict[int, Column]) -> dict[int, Row]:
    """slot -> (n, low, high, mean, std, std_pop) of double expressions, in one scan.

    The cells are unpivoted and grouped by slot: one small set of aggregates for any number of
    columns, and one row per slot and task in the shuffle. Slots without a number are absent.
    """
    if not numbers:
        return {}
    v = F.col("value")
    rows = unpivot_cells(df, numbers).groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"))
    return {r.slot: r for r in rows.collect()}


def value_counts(df: DataFrame, cells: dict[int, Column]) -> DataFrame:
    """(slot, value, n): one row per distinct cell value of each slot.

    Counting is combined before the shuffle, so a value that fills a third of a table travels as
    one row per task.
    """
    return unpivot_cells(df, cells).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class SlotSummary:
    """What the value counts of one slot say: sizes, frequent values, and counts of cell forms."""

    distinct: int = 0
    rows: int = 0
    top: list[tuple[str, int]] = field(default_factory=list)
    smallest_group: int = 0
    largest_group: int = 0
    numbers: int = 0
    dates: int = 0
    bool_like: int = 0
    sentinels: int = 0
    first_date: str | None = None
    last_date: str | None = None
    patterns: dict[str, int] = field(default_factory=dict)
    missing: dict[str, int] = field(default_factory=dict)
    missing_share: dict[str, float] = field(default_factory=dict)


def _rows_where(flag: Column) -> Column:
    """Table rows (not distinct values) whose value has the flag."""
    return F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))


def _forms(value: Column) -> Column:
    """Forms of a text cell as a bit set, in the order of ``_FORMS``."""
    tests = [to_number(value).isNotNull(), is_bool_like(value), is_sentinel_word(value),
             *[matches(value, p) for p in PATTERNS]]
    return reduce(lambda x, y: x + y, [F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)])


_FORMS = ("numbers", "bool_like", "sentinels", *PATTERNS)


def text_counts(
    df: DataFrame, cells: dict[int, Column], row_id: str | None = None, null_flags: dict[str, Column] | None = None
) -> DataFrame:
    """(slot, long, value, n, first_row, forms, day, flags...): distinct text cells of each slot.

    A cell longer than LONG_CELL is represented by its SHA-256 digest, so whole documents are not
    shuffled; its forms are tested before the shuffle. Short cells are tested after it, once per
    distinct value.
    """
    null_flags = null_flags or {}
    extra = [F.when(flag, F.lit(1)).otherwise(F.lit(0)).alias(n) for n, flag in null_flags.items()]
    if row_id:
        extra.append(col(row_id).cast("long").alias("__first"))
    return count_texts(unpivot_cells(df, cells, extra), list(null_flags))


def count_texts(long: DataFrame, flags: list[str]) -> DataFrame:
    """``text_counts`` of rows (slot, value, flags...), with the place of the cell as ``__first`` if it is known."""
    value, is_long = F.col("value"), F.col("long")
    keyed = (
        long.withColumn("long", F.length(value) > LONG_CELL)
        .withColumns({
            "key": F.when(is_long, F.sha2(value, 256)).otherwise(value),
            "long_forms": F.when(is_long, _forms(value)), "long_day": F.when(is_long, to_date(value))})
    )
    first = F.min("__first") if "__first" in long.columns else F.lit(None).cast("long")
    counts = keyed.groupBy("slot", "long", F.col("key").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), first.alias("first_row"), F.max("long_forms").alias("long_forms"),
        F.max("long_day").alias("long_day"), *[F.sum(n).alias(n) for n in flags])
    return counts.withColumns({
        "forms": F.when(is_long, F.col("long_forms")).otherwise(_forms(value)),
        "day": F.when(is_long, F.col("long_day")).otherwise(to_date(value))}).drop("long_forms", "long_day")


def whole_cells(long: DataFrame, digests: list[tuple[int, str]]) -> dict[tuple[int, str], str]:
    """Texts of a few digests among rows (slot, value): one scan."""
    if not digests:
        return {}
    found = (
        long.filter(F.length("value") > LONG_CELL)
        .withColumn("digest", F.sha2("value", 256))
        .filter(F.col("digest").isin([d for _, d in digests]))
        .groupBy("slot", "digest").agg(F.min("value").alias("value")).collect())
    return {(r.slot, r.digest): r.value for r in found}


def summarise_texts(
    df: DataFrame, cells: dict[int, Column], top: int, row_id: str | None = None,
    null_flags: dict[str, Column] | None = None,
) -> dict[int, SlotSummary]:
    """One summary per slot of text cells.

    The forms of a cell (number, date, format, ...) are tested once per distinct value and weighted
    by its count; the tests are one set of expressions, however many columns there are. The frequent
    values are limited inside every task before they are shuffled (the filter on ``row_number``
    becomes a group limit), so no task sees all values of a slot. Both branches use every column of
    the counts and meet in a union, so their plans agree and the shuffle of the counts is shared.
    """
    def texts(digests: list[tuple[int, str]]) -> dict[tuple[int, str], str]:
        return whole_cells(unpivot_cells(df, {s: cells[s] for s in {slot for slot, _ in digests}}), digests) if digests else {}

    return summarise_counts(text_counts(df, cells, row_id, null_flags), top, texts, list(null_flags or {}))


def summarise_counts(counts: DataFrame, top: int, whole_texts, flags: list[str]) -> dict[int, SlotSummary]:
    """``summarise_texts`` from the value counts; ``whole_texts`` finds the texts of (slot, digest) pairs."""
    shares = [
        x for f in flags
        for x in (F.sum(f).alias(f), F.sum(F.col(f) * F.col(f) / F.col("n")).alias(f + "_s"))
    ]
    totals = counts.groupBy("slot").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("rows"),
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("first_row").alias("first_row"),
        _rows_where(F.col("day").isNotNull()).alias("dates"),
        F.min("day").alias("first_date"), F.max("day").alias("last_date"),
        *[_rows_where(F.col("forms").bitwiseAND(F.lit(1 << i)) > 0).alias("f_" + n) for i, n in enumerate(_FORMS)],
        *shares)
    ranked = top_values(counts, top).select(
        "slot", F.struct("rank", "value", "n", "long", "first_row", "forms", "day", *flags).alias("top"))
    best = ranked.groupBy("slot").agg(F.sort_array(F.collect_list("top")).alias("top"))
    rows = totals.unionByName(best, allowMissingColumns=True).collect()
    tops = {r.slot: r.top for r in rows if r.top is not None}
    texts = whole_texts([(slot, t.value) for slot, ts in tops.items() for t in ts if t.long])
    out: dict[int, SlotSummary] = {}
    for row in rows:
        if row.top is not None:
            continue
        listed = [(texts[row.slot, t.value] if t.long else t.value, t.n) for t in tops.get(row.slot, ())]
        out[row.slot] = SlotSummary(
            row.n_distinct, row.rows, listed, row.low, row.high,
            row.f_numbers, row.dates, row.f_bool_like, row.f_sentinels,
            row.first_date and row.first_date.isoformat(), row.last_date and row.last_date.isoformat(),
            {p: row["f_" + p] for p in PATTERNS},
            {f: row[f] for f in flags}, {f: row[f + "_s"] for f in flags})
    return out


def top_values(counts: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent values per slot; ties go to the first seen, then by value."""
    order = [F.desc("n"), F.asc_nulls_last("first_row"), F.asc("value")]
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top)


def first_cells(df: DataFrame, cells: dict[int, Column], per_slot: int, row_id: str | None) -> dict[int, list[str]]:
    """First ``per_slot`` non-null cells of each slot in row order (by value without a row id).

    One scan for all slots; every task keeps its first cells per slot before the shuffle (group limit).
    """
    order = col(row_id).cast("long") if row_id else F.lit(0).cast("long")
    seen = unpivot_cells(df, {slot: c.cast("string") for slot, c in cells.items()}, [order.alias("first")])
    place = F.row_number().over(Window.partitionBy("slot").orderBy("first", "value"))
    out: dict[int, list[str]] = {slot: [] for slot in cells}
    for row in seen.withColumn("place", place).filter(F.col("place") <= per_slot).orderBy("slot", "place").collect():
        out[row.slot].append(row.value)
    return out


def modes(df: DataFrame, cells: dict[int, Column]) -> dict[int, object]:
    """Most frequent value per slot, the smallest among ties. All cells must have one type."""
    counts = value_counts(df, cells)
    order = [F.desc("n"), F.asc("value")]
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
    return {r.slot: r.value for r in ranked.filter(F.col("rank") <= 1).collect()}
