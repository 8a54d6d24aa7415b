"""Profile of a table: one record per column plus the table counters behind the score."""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions import constants as K
from limpid.functions.coerce import (
    cell_text, col, is_sentinel_word, nan_to_null, number_text, storage_of, strip, to_number,
)
from limpid.functions.quantiles import exact_quantiles
from limpid.operators.duplicates import count_duplicates
from limpid.operators.missingness import Association, chi_square, first_associations, point_biserial
from limpid.operators.sketches import approximate_quantiles
from limpid.operators.values import SlotSummary, first_cells, number_moments, summarise_texts, unpivot_cells, value_counts
from limpid.session import aggregate_in_groups, count_rows, fresh_path, kept_if_small, stage
from limpid.sources.tables import ROW_ID, data_columns

# A repeated extreme value is listed in the plan; more of them than this are kept as a table.
SENTINEL_LIST_LIMIT = 10_000

COLUMN_SCHEMA = (
    "column string, ordinal int, storage_type string, detected_type string, null_count long, "
    "null_pct double, invalid_count long, stats struct<min:double,max:double,mean:double,"
    "median:double,std:double,q1:double,q3:double,min_date:string,max_date:string,"
    "histogram:struct<counts:array<long>,edges:array<double>>>, "
    "outliers struct<count:long,method:string,lower:double,upper:double>, sentinel_count long, "
    "sentinel_values array<string>, unique_count long, cardinality_pct double, "
    "top_values array<struct<value:string,count:long>>, pattern string, "
    "format_inconsistency boolean, castable_pct double, non_castable_sample array<string>"
)
TABLE_SCHEMA = (
    "total_rows long, total_columns int, total_cells long, missing_cells long, duplicate_rows long, "
    "malformed_rows long, invalid_cells long, completeness double, uniqueness double, "
    "validity double, consistency double"
)


@dataclass
class ColumnProfile:
    column: str
    ordinal: int
    storage_type: str
    detected_type: str
    null_count: int = 0
    null_pct: float = 0.0
    invalid_count: int = 0
    stats: dict = field(default_factory=dict)
    outliers: dict | None = None
    sentinel_count: int = 0
    sentinel_values: list = field(default_factory=list)
    sentinel_table: str | None = None
    unique_count: int | None = None
    cardinality_pct: float | None = None
    top_values: list = field(default_factory=list)
    pattern: str | None = None
    format_inconsistency: bool | None = None
    castable_pct: float | None = None
    non_castable_sample: list = field(default_factory=list)

    @property
    def is_numeric_like(self) -> bool:
        return self.detected_type in ("numeric", "date")

    @property
    def outlier_count(self) -> int:
        return (self.outliers or {}).get("count", 0)

    @property
    def has_sentinels(self) -> bool:
        return bool(self.sentinel_values) or self.sentinel_table is not None


def with_sentinel_tables(frame: DataFrame, tables: dict[str, str | None]) -> DataFrame:
    """``frame`` (column, sentinel_values, ...) with the sentinel sets that are kept as tables in ``sentinel_values``."""
    spark = frame.sparkSession
    found = None
    for name, path in tables.items():
        if path:
            listed = F.transform(F.sort_array(F.collect_list("value")), number_text)
            one = spark.read.parquet(path).agg(listed.alias("__listed")).select(F.lit(name).alias("__column"), "__listed")
            found = one if found is None else found.unionByName(one)
    if found is None:
        return frame
    # the size of the sets is not bounded: Spark chooses the join
    joined = frame.join(found, F.col("column") == F.col("__column"), "left")
    return joined.withColumn("sentinel_values", F.coalesce("__listed", "sentinel_values")).select(frame.columns)


@dataclass
class TableProfile:
    total_rows: int
    total_columns: int
    missing_cells: int
    duplicate_rows: int
    malformed_rows: int
    invalid_cells: int
    completeness: float
    uniqueness: float
    validity: float
    consistency: float
    columns: list[ColumnProfile]
    associations: list[Association] | None = None
    association_tests: dict[tuple[str, str], tuple[str, float, float]] = field(default_factory=dict)

    @property
    def total_cells(self) -> int:
        return self.total_rows * self.total_columns

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.column == name)

    def table_frame(self, spark: SparkSession) -> DataFrame:
        names = [f.split()[0] for f in TABLE_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(getattr(self, n) for n in names)], TABLE_SCHEMA)

    def column_frame(self, spark: SparkSession) -> DataFrame:
        """One row per column. ``sentinel_values`` and top values read as text."""
        rows = []
        for c in self.columns:
            d = asdict(c)
            d.pop("sentinel_table")
            d["sentinel_values"] = [str(v) for v in c.sentinel_values]
            d["top_values"] = [{"value": v, "count": n} for v, n in c.top_values]
            rows.append(d)
        return with_sentinel_tables(spark.createDataFrame(rows, COLUMN_SCHEMA), {c.column: c.sentinel_table for c in self.columns})


@dataclass
class _Cells:
    """Expressions of one column over the profiled frame."""

    name: str
    slot: int
    storage: str
    raw: Column
    number: Column


def _cells(df: DataFrame, row_id: str | None) -> list[_Cells]:
    out = []
    for slot, name in enumerate(data_columns(df, row_id)):
        kind = df.schema[name].dataType
        storage = storage_of(kind)
        raw = nan_to_null(col(name), kind)
        out.append(_Cells(name, slot, storage, raw, to_number(raw, storage)))
    return out


def _is_numeric_storage(c: _Cells) -> bool:
    return c.storage in ("int", "float")


def _first_pass(df: DataFrame, cells: list[_Cells]) -> tuple[dict, dict]:
    """Filled cells and date spans of all columns, and the moments of native numbers by slot, in one scan.

    Cells are unpivoted, so the aggregates do not grow with the width of the table.
    """
    def parts(c: _Cells) -> list[Column]:
        number = c.number if c.storage in ("int", "float", "bool") else F.lit(None).cast("double")
        day = c.raw.cast("date") if c.storage == "timestamp" else F.lit(None).cast("date")
        return [F.lit(c.slot), c.raw.isNotNull(), number, day]

    if not cells:
        return {}, {}
    long = df.select(F.stack(F.lit(len(cells)), *[x for c in cells for x in parts(c)]).alias("slot", "filled", "number", "day"))
    x = F.col("number")
    rows = long.where("filled").groupBy("slot").agg(
        F.count("filled").alias("filled"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.count(x).alias("n"),
        F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.stddev_pop(x).alias("std_pop"))
    base: dict = {f"n{c.slot}": 0 for c in cells}
    moments = {}
    for r in rows.collect():
        base |= {f"n{r.slot}": r.filled, f"from{r.slot}": r.first, f"to{r.slot}": r.last}
        if r.n:
            moments[r.slot] = r
    return base, moments


def detect_type(storage: str, filled: int, n_number: int, n_date: int, n_bool: int) -> str:
    """Semantic type; for text the number test comes before the date test."""
    if storage in ("int", "float"):
        return "numeric"
    if storage == "bool":
        return "bool"
    if storage == "timestamp":
        return "date"
    if filled == 0:
        return "string"
    if n_bool == filled:
        return "bool"
    if n_number / filled >= K.DETECT_SHARE:
        return "numeric"
    if n_date / filled >= K.DETECT_SHARE:
        return "date"
    return "string"


def dominant_pattern(counts: dict[str, int], filled: int) -> str | None:
    """First format, in library order, that more than half of the cells have."""
    if not filled:
        return None
    return next((p for p in K.PATTERNS if counts.get(p, 0) / filled > K.MAJORITY_SHARE), None)


def histogram_edges(low: float, high: float) -> list[float]:
    """Edges of equal-width bins; a constant column is widened by one half on both sides."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / K.HISTOGRAM_BINS
    return [low + i * step for i in range(K.HISTOGRAM_BINS)] + [high]


def profile_table(
    df: DataFrame, malformed_rows: int = 0, row_id: str | None = ROW_ID, missingness: bool = False, approx: bool = False,
    lasting: str | None = None,
) -> TableProfile:
    """Profile every column of ``df``.

    ``row_id`` names a long column that orders the rows; it is not profiled and only breaks ties.
    With ``missingness`` the value counts also feed the missing-at-random test, so that test needs
    no shuffle of its own. With ``approx`` medians and quartiles, and the fences that follow from them,
    come from one scan into sketches (``sketches.rank_error``) instead of the exact search. Sentinel
    sets that become tables are written under the folder ``lasting``, so that a stored plan can name
    them for as long as it is kept; without one they lie in the scratch folder.
    """
    row_id = row_id if row_id in df.columns else None
    rows = count_rows(df)
    with kept_if_small(df, rows, len(df.columns)) as kept:
        return _profile(kept, rows, malformed_rows, row_id, missingness, approx, lasting)


def _profile(
    df: DataFrame, rows: int, malformed_rows: int, row_id: str | None, missingness: bool, approx: bool = False,
    lasting: str | None = None,
) -> TableProfile:
    """Three strands of jobs that do not wait for each other: numbers, texts, duplicates."""
    cells = _cells(df, row_id)
    with ThreadPoolExecutor(3) as pool:
        duplicates = pool.submit(count_duplicates, df, row_id, rows)
        base, moments = _first_pass(df, cells)
        nulls = {c.slot: rows - base[f"n{c.slot}"] for c in cells}
        texts = pool.submit(_summaries, df, cells, nulls, row_id, missingness)
        native = [c for c in cells if c.storage in ("int", "float", "timestamp")]
        profiles = {c.name: _start_profile(c, rows, nulls[c.slot]) for c in cells}
        numbers = pool.submit(_numeric_profiles, df, native, base, moments, profiles, approx, lasting)
        summaries = texts.result()
        invalid = inconsistent = 0
        for c in cells:
            if c.storage in ("object", "bool"):
                bad, odd = _text_profile(c, profiles[c.name], rows - nulls[c.slot], summaries.get(c.slot, SlotSummary()))
                invalid, inconsistent = invalid + bad, inconsistent + odd
        parsed = [c for c in cells if c.storage == "object" and profiles[c.name].is_numeric_like]
        if parsed:
            base |= {f"from{c.slot}": summaries[c.slot].first_date for c in parsed}
            base |= {f"to{c.slot}": summaries[c.slot].last_date for c in parsed}
            in_text = number_moments(df, {c.slot: c.number for c in parsed if summaries[c.slot].numbers})
            _numeric_profiles(df, parsed, base, in_text, profiles, approx, lasting)
        _text_samples(df, cells, profiles, row_id)
        numbers.result()
        copies = duplicates.result()

    out = table_counters([profiles[c.name] for c in cells], rows, sum(nulls.values()), copies, malformed_rows, invalid, inconsistent)
    if missingness:
        out.association_tests = _association_tests(df, cells, nulls, rows, moments, summaries)
        tested = dict.fromkeys(column for column, _ in out.association_tests)
        out.associations = first_associations([c.name for c in cells], list(tested), out.association_tests)
    return out


def table_counters(
    columns: list[ColumnProfile], rows: int, missing: int, copies: int, malformed_rows: int, invalid: int, inconsistent: int
) -> TableProfile:
    """Profile of a table from the profiles of its columns and the counts over all cells."""
    total_cells = rows * len(columns)
    return TableProfile(
        rows, len(columns), missing, copies, malformed_rows, invalid,
        (1 - missing / total_cells) * 100 if total_cells else 100.0,
        (1 - copies / rows) * 100 if rows else 100.0,
        round((total_cells - missing - invalid) / total_cells * 100, 2) if total_cells else 100.0,
        round((1 - inconsistent / total_cells) * 100, 2) if total_cells else 100.0, columns)


def _start_profile(c: _Cells, rows: int, nulls: int) -> ColumnProfile:
    """Storage, gaps and, for native types, the detected type."""
    storage = c.storage
    if nulls:
        # integers with gaps are stored as float, booleans with gaps as objects
        storage = {"int": "float", "bool": "object"}.get(storage, storage)
    kind = "string" if c.storage == "object" else detect_type(c.storage, rows - nulls, 0, 0, 0)
    return ColumnProfile(c.name, c.slot, storage, kind, nulls, round(nulls / rows * 100, 1) if rows else 0.0)


def _text_profile(c: _Cells, p: ColumnProfile, filled: int, found: SlotSummary) -> tuple[int, int]:
    """Complete the profile of a text or boolean column; returns its invalid and inconsistent cells."""
    p.detected_type = detect_type(c.storage, filled, found.numbers, found.dates, found.bool_like)
    if not p.is_numeric_like:
        p.unique_count, p.top_values = found.distinct, found.top
        p.cardinality_pct = round(found.distinct / filled * 100, 1) if filled else 0.0
        p.castable_pct, p.format_inconsistency = 0.0, False
    if c.storage == "bool" or not filled:
        return 0, 0
    pattern = dominant_pattern(found.patterns, filled)
    misfits = filled - found.patterns[pattern] if pattern else 0
    if p.detected_type == "numeric":
        p.invalid_count = filled - found.numbers
    elif p.detected_type == "date":
        p.invalid_count = filled - found.dates
    else:
        p.pattern = pattern
        p.invalid_count = misfits if p.detected_type == "string" else 0
        p.sentinel_count = found.sentinels
        p.castable_pct = round(found.numbers / filled * 100, 1)
        p.format_inconsistency = found.numbers >= 5 and p.castable_pct < K.DETECT_SHARE * 100
    if found.numbers / filled > K.MAJORITY_SHARE:
        return filled - found.numbers, misfits
    if found.dates / filled > K.MAJORITY_SHARE:
        return filled - found.dates, misfits
    return 0, misfits


def _summaries(
    df: DataFrame, cells: list[_Cells], nulls: dict[int, int], row_id: str | None, missingness: bool
) -> dict[int, SlotSummary]:
    """Value summaries of text and boolean columns.

    For the missing-at-random test the same counts also carry the null flags of other columns, and
    native timestamps are counted as categories.
    """
    flags = {f"m{c.slot}": c.raw.isNull() for c in cells
             if missingness and nulls[c.slot] >= K.MISSINGNESS_MIN_NULLS}
    kinds = ("object", "bool", "timestamp") if flags else ("object", "bool")
    chosen = {c.slot: cell_text(c.raw, c.storage) for c in cells if c.storage in kinds}
    if not chosen:
        return {}
    return summarise_texts(df, chosen, K.TOP_VALUES, row_id, flags)


def _numeric_profiles(
    df: DataFrame, cells: list[_Cells], base: dict, moments: dict, profiles: dict[str, ColumnProfile],
    approx: bool = False, lasting: str | None = None,
) -> None:
    """Moments, quartiles, fences, histogram and repeated extremes of numeric and date columns."""
    chosen: dict[str, _Cells] = {}
    for c in cells:
        p = profiles[c.name]
        p.outliers = {"count": 0, "method": "IQR", "lower": None, "upper": None}
        if c.slot in moments:
            chosen[c.name] = c
        elif base.get(f"from{c.slot}"):
            p.stats = {"min_date": base[f"from{c.slot}"], "max_date": base[f"to{c.slot}"]}
    if not chosen:
        return
    ranges = {n: (moments[c.slot].n, moments[c.slot].low, moments[c.slot].high) for n, c in chosen.items()}
    numbers = {n: c.number for n, c in chosen.items()}
    quarters = [0.25, 0.5, 0.75]
    quartiles = approximate_quantiles(df, numbers, quarters) if approx else exact_quantiles(df, numbers, ranges, quarters)

    bounds: dict[str, tuple[float, float]] = {}
    edges: dict[str, list[float]] = {}
    fences: dict[str, tuple[float, float]] = {}
    for name, c in chosen.items():
        found = number_facts(profiles[name], moments[c.slot], [quartiles[name][q] for q in (0.25, 0.5, 0.75)])
        for kept, value in zip((bounds, edges, fences), found):
            if value is not None:
                kept[name] = value
    if bounds or edges:
        for slot, row in _fence_counts(df, chosen, bounds, edges).items():
            name = next(n for n, c in chosen.items() if c.slot == slot)
            note_fences(profiles[name], edges.get(name), row.n, row.outside, row.above)
    if fences:
        _numeric_sentinels(df, {n: chosen[n] for n in fences}, fences, profiles, lasting)


def number_facts(p: ColumnProfile, m, quartiles: list[float]) -> tuple:
    """Complete the figures of a column from its moments and quartiles.

    Returns its fences, the edges of its histogram and its wide fences, each None if there are none.
    """
    q1, median, q3 = quartiles
    bounds = edges = wide = None
    p.stats = {
        "min": round(m.low, 4), "max": round(m.high, 4), "mean": round(m.mean, 4),
        "median": round(median, 4), "std": round(m.std, 4) if m.n > 1 else 0.0}
    iqr = q3 - q1
    if m.n >= K.OUTLIER_MIN_ROWS:
        bounds = round(q1 - K.IQR_FENCE * iqr, 4), round(q3 + K.IQR_FENCE * iqr, 4)
        p.outliers |= {"lower": bounds[0], "upper": bounds[1]}
        p.stats |= {"q1": round(q1, 4), "q3": round(q3, 4)}
    if m.n >= K.HISTOGRAM_MIN_ROWS and math.isfinite(m.low) and math.isfinite(m.high):
        edges = histogram_edges(m.low, m.high)
    if m.n >= K.SENTINEL_MIN_ROWS and iqr != 0:
        fence = (q1 - K.SENTINEL_FENCE * iqr, q3 + K.SENTINEL_FENCE * iqr)
        if m.low < fence[0] or m.high > fence[1]:
            wide = fence
    return bounds, edges, wide


def note_fences(p: ColumnProfile, edges: list[float] | None, n: int, outside: int, above: list[int]) -> None:
    """Outliers and histogram from the cells outside the fences and those at or above each inner edge."""
    p.outliers["count"] = outside
    if edges is not None:
        steps = [n, *above, 0]
        p.stats["histogram"] = {"counts": [a - b for a, b in zip(steps, steps[1:])], "edges": [round(e, 4) for e in edges]}


def _fence_counts(
    df: DataFrame, chosen: dict[str, _Cells], bounds: dict[str, tuple[float, float]], edges: dict[str, list[float]]
) -> dict:
    """slot -> cells, cells outside the fences, and cells at or above each inner histogram edge.

    The bounds of all columns are looked up by position, so the aggregates do not grow with them.
    """
    names = [n for n in chosen if n in bounds or n in edges]
    inner = K.HISTOGRAM_BINS - 1

    def lookup(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])[F.col("slot")]

    lows = lookup([bounds.get(n, (-math.inf, math.inf))[0] for n in names])
    highs = lookup([bounds.get(n, (-math.inf, math.inf))[1] for n in names])
    v = F.col("value")
    steps = [lookup([edges[n][i] if n in edges else math.inf for n in names]) for i in range(1, inner + 1)]
    rows = unpivot_cells(df, {i: chosen[n].number for i, n in enumerate(names)}).groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((v < lows) | (v > highs)).alias("outside"),
        *[F.count_if(v >= e).alias(f"above{i}") for i, e in enumerate(steps)])
    found = rows.select("slot", "n", "outside", F.array(*[F.col(f"above{i}") for i in range(inner)]).alias("above"))
    return {chosen[names[r.slot]].slot: r for r in found.collect()}


def _numeric_sentinels(
    df: DataFrame, chosen: dict[str, _Cells], fences: dict[str, tuple[float, float]],
    profiles: dict[str, ColumnProfile], lasting: str | None = None,
) -> None:
    """Values outside the wide fences that repeat: a code for "no value", such as -999."""
    outside = {
        c.slot: F.when((c.number < fences[n][0]) | (c.number > fences[n][1]), c.number)
        for n, c in chosen.items()}
    repeated = value_counts(df, outside).filter(F.col("n") >= K.SENTINEL_MIN_REPEATS).select("slot", "value", "n")
    note_sentinels(repeated, {c.slot: profiles[n] for n, c in chosen.items()}, lasting)


def note_sentinels(repeated: DataFrame, profiles: dict[int, ColumnProfile], lasting: str | None = None) -> None:
    """Add repeated extremes (slot, value, n) to the profiles of their columns; long sets become tables under ``lasting``."""
    repeated = stage(repeated, "repeated-extremes")
    totals = repeated.groupBy("slot").agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("k")).collect()
    listed = []
    for row in totals:
        p = profiles[row.slot]
        p.sentinel_count = row.cells
        if row.k <= SENTINEL_LIST_LIMIT:
            listed.append(row.slot)
        else:
            p.sentinel_table = f"{lasting.rstrip('/')}/{uuid.uuid4().hex}" if lasting else fresh_path(repeated.sparkSession, "sentinels")
            repeated.filter(F.col("slot") == row.slot).select("value").write.parquet(p.sentinel_table)
    if listed:
        for row in repeated.filter(F.col("slot").isin(listed)).orderBy("slot", "value").collect():
            profiles[row.slot].sentinel_values.append(row.value)


def _text_samples(df: DataFrame, cells: list[_Cells], profiles: dict[str, ColumnProfile], row_id: str | None) -> None:
    """Spellings of sentinel words, and sample cells of columns with mixed formats."""
    with_words = {c.slot: c for c in cells if not profiles[c.name].is_numeric_like and profiles[c.name].sentinel_count}
    if with_words:
        # at most the case variants of ten short words per column
        words = unpivot_cells(df, {s: F.when(is_sentinel_word(c.raw), strip(c.raw)) for s, c in with_words.items()})
        for row in words.distinct().collect():
            profiles[with_words[row.slot].name].sentinel_values.append(row.value)
        for c in with_words.values():
            profiles[c.name].sentinel_values.sort()
    mixed = {c.slot: c for c in cells if profiles[c.name].format_inconsistency}
    if mixed:
        bad = {s: F.when(c.number.isNull(), c.raw) for s, c in mixed.items()}
        for slot, sample in first_cells(df, bad, K.SAMPLE_CELLS, row_id).items():
            profiles[mixed[slot].name].non_castable_sample = sample


# Numeric columns whose means are taken in one job of the missing-at-random test.
_MEANS_PER_JOB = 50


def _association_tests(
    df: DataFrame, cells: list[_Cells], nulls: dict[int, int], rows: int, moments: dict,
    summaries: dict[int, SlotSummary],
) -> dict[tuple[str, str], tuple[str, float, float]]:
    """(test, statistic, p) of every column with enough nulls against every other column."""
    if rows < K.MISSINGNESS_MIN_ROWS:
        return {}
    gappy = [c for c in cells if nulls[c.slot] >= K.MISSINGNESS_MIN_NULLS]
    others = [c for c in cells if rows - nulls[c.slot] >= K.MISSINGNESS_MIN_ROWS]
    numeric = [o for o in others if _is_numeric_storage(o) or o.storage == "bool" and not nulls[o.slot]]
    by_mean = {o.slot for o in numeric}
    means = _means_where_missing(df, gappy, numeric)
    tests: dict[tuple[str, str], tuple[str, float, float]] = {}
    for g in gappy:
        for o in others:
            if o.slot == g.slot:
                continue
            if o.slot in by_mean:
                m = moments[o.slot]
                tests[g.name, o.name] = ("point_biserial", *point_biserial(
                    m.n, m.mean, m.std_pop, *means.get((g.slot, o.slot), (0, None))))
            elif o.slot in summaries:
                tests[g.name, o.name] = ("chi2", *chi_square(summaries[o.slot], f"m{g.slot}"))
    return tests


def _means_where_missing(
    df: DataFrame, gappy: list[_Cells], numeric: list[_Cells]
) -> dict[tuple[int, int], tuple[int, float | None]]:
    """(gappy slot, numeric slot) -> count and mean of the number over rows where the first is missing.

    A row is repeated once per gap it has, and grouped by the column of the gap.
    """
    out: dict[tuple[int, int], tuple[int, float | None]] = {}
    if not gappy:
        return out
    flags = [x for g in gappy for x in (F.lit(g.slot), g.raw.isNull())]
    for start in range(0, len(numeric), _MEANS_PER_JOB):
        part = numeric[start:start + _MEANS_PER_JOB]
        per_gap = (
            df.select(*[o.number.alias(f"x{o.slot}") for o in part], F.stack(F.lit(len(gappy)), *flags).alias("gap", "missing"))
            .filter(F.col("missing")).groupBy("gap")
            .agg(*[x for o in part for x in (F.count(f"x{o.slot}").alias(f"n{o.slot}"), F.avg(f"x{o.slot}").alias(f"a{o.slot}"))]))
        for row in per_gap.collect():
            for o in part:
                out[row.gap, o.slot] = (row[f"n{o.slot}"], row[f"a{o.slot}"])
    return out


def detect_missingness(df: DataFrame, row_id: str | None = ROW_ID) -> list[Association]:
    """Columns whose nulls depend on another column, first hit in column order."""
    return profile_table(df, row_id=row_id, missingness=True).associations or []
