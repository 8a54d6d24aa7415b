"""Profiles of many small CSV files by one set of jobs.

Every column of every file is a slot. The files are parsed together, their cells become rows (slot,
row, value), and each statistic is one grouping by slot: the number of jobs does not depend on the
number of files or columns. The driver receives what a report holds, a bounded number of figures per
slot. Facts of a slot that later passes need travel as a small table, one row per slot or file.

Meant for files of about one block, such as a batch of arrivals: quartiles are read from the ordered
value counts of a slot, which one task holds. Results are those of ``profile_table`` on ``read_csv``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limpid.functions import constants as K
from limpid.functions.coerce import INTEGER_RE, NUMBER_RE, fold_null_tokens, is_sentinel_word, strip, to_number
from limpid.functions.quantiles import _interpolate, _wanted_ranks
from limpid.operators.impact import DUPLICATE
from limpid.operators.masks import ALL_ROWS, masks_of_numbers
from limpid.operators.missingness import chi_square, first_associations, point_biserial
from limpid.operators.profile import (
    ColumnProfile, TableProfile, _Cells, _start_profile, _text_profile, note_fences, note_sentinels, number_facts, table_counters,
)
from limpid.operators.values import LONG_CELL, SlotSummary, count_texts, summarise_counts, whole_cells
from limpid.plans.model import Plan
from limpid.session import stage
from limpid.sources.blocks import FIELD_END, split_records
from limpid.sources.csv import CSV_OPTIONS, field_count, paths_of, unique_names

_QUARTERS = (0.25, 0.5, 0.75)
_STORAGE = {"bigint": "int", "double": "float", "boolean": "bool", "string": "object"}


def plain_path(address: str) -> str:
    """An address of a file in the one form that Spark's lists and columns can be brought to."""
    return re.sub("^file:/+", "file:/", address)


def address_of(spark: SparkSession, path: str) -> str:
    """The address of a path, in the form of ``plain_path``."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found)
    return plain_path(whole.toUri().toString())


@dataclass
class _File:
    """One file: its number, its columns, and the slots they have."""

    number: int
    path: str
    names: list[str]
    first: int
    rows: int = 0
    malformed: int = 0
    copies: int = 0
    cells: list[_Cells] = field(default_factory=list)
    nulls: dict[int, int] = field(default_factory=dict)
    profiles: dict[int, ColumnProfile] = field(default_factory=dict)

    @property
    def slots(self) -> range:
        return range(self.first, self.first + len(self.names))


@dataclass
class ManyProfiles:
    """Profiles by path, the reasons of files that have none, and the typed cells behind them."""

    profiles: dict[str, TableProfile]
    failures: dict[str, str]
    files: list[_File]
    rows: DataFrame
    cells: DataFrame

    def flag_masks(self, plans: dict[str, Plan], keys: dict[str, str]) -> DataFrame:
        """(key, operation, bucket, mask): the drop flags of every file under its plan, as ``masks.flag_masks`` has them."""
        spark, facts = self.rows.sparkSession, []
        for f in self.files:
            plan = plans[f.path]
            for c in f.cells:
                rule, out = plan.columns.get(c.name), plan.outliers.get(c.name)
                listed = (rule.sentinel_values or []) if rule and rule.missing_values else []
                numbers = [float(v) for v in listed if isinstance(v, (int, float)) and c.storage in ("int", "float")]
                words = [v for v in listed if isinstance(v, str) and c.storage == "object"]
                bounds = (out.lower, out.upper) if out and out.lower is not None and out.upper is not None else (None, None)
                if rule and rule.missing_values or bounds[0] is not None:
                    facts.append((c.slot, c.name, bool(rule and rule.missing_values), numbers, words, *bounds))
        table = spark.createDataFrame(facts, "slot int, name string, ruled boolean, numbers array<double>, words array<string>, lower double, upper double")
        joined = self.cells.join(F.broadcast(table), "slot")
        listed = F.array_contains("numbers", F.col("number")) | F.array_contains("words", F.col("value"))
        empty = F.col("ruled") & (F.col("value").isNull() | F.coalesce(listed, F.lit(False)))
        outside = F.coalesce((F.col("number") < F.col("lower")) | (F.col("number") > F.col("upper")), F.lit(False))
        names = F.filter(F.array(F.when(empty, F.concat(F.lit("null_"), "name")), F.when(outside, F.concat(F.lit("outlier_"), "name"))),
                         lambda x: x.isNotNull())
        flagged = joined.select("file_no", "row", F.explode(names).alias("operation"))
        copies = Window.partitionBy("file_no", "row_key").orderBy("row")
        marked = self.rows.withColumn("copy", F.row_number().over(copies) > 1).select(
            "file_no", "row", F.explode(F.when(F.col("copy"), F.array(F.lit(ALL_ROWS), F.lit(DUPLICATE))).otherwise(F.array(F.lit(ALL_ROWS)))).alias("operation"))
        named = F.broadcast(spark.createDataFrame([(f.number, keys[f.path]) for f in self.files], "file_no int, key string"))
        return masks_of_numbers(flagged.unionByName(marked).join(named, "file_no").select(
            "key", "operation", (F.col("row") + 1).alias("number")), ["key"])


def profile_files(spark: SparkSession, paths: Iterable[str], has_header: bool = True, lasting: str | None = None) -> ManyProfiles:
    """Profile every CSV file under ``paths``, each with its own header, by its ``plain_path``.

    A file without any record has no profile.
    """
    listed = spark.read.text(list(paths)).inputFiles()
    records = stage(split_records(spark, paths_of(listed)), "records")
    files = _headers(records, has_header)
    readable = {f.path for f in files}
    failures = {p: f"no columns to read in {p}" for p in map(plain_path, listed) if p not in readable}
    if not files:
        return ManyProfiles({}, failures, [], records, records)
    rows = _rows(records, files, has_header)
    typed, cells = _typed(rows, files)
    summaries = _summaries(cells)
    moments = {r.slot: r for r in cells.where("number is not null").groupBy("slot").agg(
        F.count("number").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.avg("number").alias("mean"),
        F.stddev_samp("number").alias("std"), F.stddev_pop("number").alias("std_pop")).collect()}
    totals = _column_profiles(files, summaries)
    _numbers(cells, files, moments, summaries, lasting)
    _samples(cells, files)
    for r in typed.groupBy("file_no", "row_key").count().groupBy("file_no").agg(F.sum(F.col("count") - 1).alias("n")).collect():
        files[r.file_no].copies = r.n
    means, shares = _where_missing(cells)
    out = {}
    for f in files:
        invalid, inconsistent = totals[f.number]
        table = table_counters([f.profiles[s] for s in f.slots], f.rows, sum(f.nulls.values()), f.copies, f.malformed, invalid, inconsistent)
        table.association_tests = _association_tests(f, moments, means, shares, summaries)
        tested = dict.fromkeys(column for column, _ in table.association_tests)
        table.associations = first_associations(f.names, list(tested), table.association_tests)
        out[f.path] = table
    return ManyProfiles(out, failures, files, typed, cells)


def _parsed(records: DataFrame, width: int) -> Column:
    """Cells of ``text`` as an array of ``width`` texts."""
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(width)), CSV_OPTIONS | {"multiLine": "true"})
    return F.transform(F.array(cells), lambda s: F.array(*[s[f"c{i}"] for i in range(width)]))[0]


def _headers(records: DataFrame, has_header: bool) -> list[_File]:
    """Files with their columns, from the first record of each: one row per file comes to the driver."""
    first = records.where("number = 0").withColumn("k", (F.regexp_count("text", F.lit(FIELD_END)) + 1))
    width = first.agg(F.max("k")).first()[0]
    if width is None:
        return []
    found = first.select("file", F.slice(_parsed(first, width), F.lit(1), F.col("k")).alias("cells")).collect()
    files, slot = [], 0
    for r in sorted(found, key=lambda r: r.file):
        if all(c is None for c in r.cells):
            continue
        header = [c or "" for c in r.cells]
        header[0] = header[0].lstrip("\ufeff")
        names = unique_names(header) if has_header else [f"col_{i}" for i in range(len(header))]
        files.append(_File(len(files), plain_path(r.file), names, slot))
        slot += len(names)
    return files


def _rows(records: DataFrame, files: list[_File], has_header: bool) -> DataFrame:
    """(file_no, row, first, cells) of well-formed records; counts rows and malformed records per file."""
    spark = records.sparkSession
    info = spark.createDataFrame([(f.path, f.number, len(f.names), f.first) for f in files], "path string, file_no int, k int, first int")
    path = F.regexp_replace("file", "^file:/+", "file:/")
    joined = records.where("number > 0" if has_header else "true").join(F.broadcast(info), path == F.col("path"))
    width = max(len(f.names) for f in files)
    parsed = joined.select(
        "file_no", "first", (F.col("number") - (1 if has_header else 0)).alias("row"),
        F.transform(F.slice(_parsed(joined, width), F.lit(1), F.col("k")), fold_null_tokens).alias("cells"),
        ((F.regexp_count("text", F.lit(FIELD_END)) + 1 != F.col("k")) & (field_count(F.col("text")) > F.col("k"))).alias("malformed"))
    staged = stage(parsed, "many-rows")
    for r in staged.groupBy("file_no").agg(F.count_if(~F.col("malformed")).alias("rows"), F.count_if("malformed").alias("bad")).collect():
        files[r.file_no].rows, files[r.file_no].malformed = r.rows, r.bad
    return staged.where("not malformed").drop("malformed")


def _typed(rows: DataFrame, files: list[_File]) -> tuple[DataFrame, DataFrame]:
    """Rows with their keys, and cells (file_no, row, gaps, slot, kind, value, number, text), both staged.

    ``gaps`` lists the slots of columns with enough gaps that are empty in the row.
    """
    spark = rows.sparkSession
    value = F.col("value")
    counts = {r.slot: r for r in rows.select("first", F.posexplode("cells").alias("pos", "value"))
              .groupBy((F.col("first") + F.col("pos")).alias("slot")).agg(
        F.count(value).alias("n"), F.count_if(value.rlike(INTEGER_RE) & value.try_cast("bigint").isNotNull()).alias("i"),
        F.count_if(value.rlike(NUMBER_RE)).alias("f"), F.count_if(value.isin(*K.CSV_BOOL_WORDS)).alias("b")).collect()}
    facts = []
    for f in files:
        kinds = []
        for slot, name in zip(f.slots, f.names):
            c = counts.get(slot)
            if c is None:
                kind = "string"
            elif c.n == f.rows and c.i == c.n:
                kind = "bigint"
            else:
                kind = "double" if c.f == c.n else "boolean" if c.b == c.n else "string"
            kinds.append(_STORAGE[kind])
            f.nulls[slot] = f.rows - (c.n if c else 0)
            f.cells.append(_Cells(name, slot, kinds[-1], None, None))
            f.profiles[slot] = _start_profile(f.cells[-1], f.rows, f.nulls[slot])
            f.profiles[slot].ordinal = slot - f.first
        facts.append((f.number, kinds, [f.nulls[s] >= K.MISSINGNESS_MIN_NULLS and f.rows >= K.MISSINGNESS_MIN_ROWS for s in f.slots]))
    info = F.broadcast(spark.createDataFrame(facts, "file_no int, kinds array<string>, gappy array<boolean>"))

    def same(x: Column, i: Column) -> Column:
        """Text that equal cells of the column's type share."""
        kind = F.get("kinds", i)
        text = (F.when(kind == "int", x.try_cast("bigint").cast("string")).when(kind == "float", (x.try_cast("double") + 0.0).cast("string"))
                .when(kind == "bool", F.lower(x)).otherwise(x))
        return F.when(x.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text))

    texts = F.transform("cells", same)
    gaps = F.filter(F.transform("cells", lambda x, i: F.when(x.isNull() & F.get("gappy", i), F.col("first") + i)), lambda x: x.isNotNull())
    typed = stage(rows.join(info, "file_no").select(
        "file_no", "row", "first", "cells", "kinds", gaps.alias("gaps"),
        F.struct(F.xxhash64(texts).alias("h"), F.xxhash64(F.lit("second"), texts).alias("k")).alias("row_key")), "many-typed")
    long = typed.select("file_no", "row", "first", "kinds", "gaps", F.posexplode("cells").alias("pos", "value")).withColumn("kind", F.get("kinds", F.col("pos")))
    yes = value.try_cast("boolean")
    number = (F.when(F.col("kind").isin("int", "float"), value.try_cast("double"))
              .when(F.col("kind") == "bool", F.when(yes, 1.0).when(~yes, 0.0)).otherwise(to_number(value)))
    text = F.when(F.col("kind") == "bool", F.when(yes, "True").when(~yes, "False")).when(F.col("kind") == "object", value)
    cells = stage(long.select("file_no", "row", "gaps", (F.col("first") + F.col("pos")).alias("slot"), "kind", "value",
                              number.alias("number"), text.alias("text")), "many-cells")
    return typed, cells


def _text_cells(cells: DataFrame) -> DataFrame:
    return cells.where("text is not null").select("slot", F.col("text").alias("value"), F.col("row").alias("__first"))


def _summaries(cells: DataFrame) -> dict[int, SlotSummary]:
    texts = _text_cells(cells)
    return summarise_counts(count_texts(texts, []), K.TOP_VALUES, lambda digests: whole_cells(texts, digests), [])


def _column_profiles(files: list[_File], summaries: dict[int, SlotSummary]) -> dict[int, tuple[int, int]]:
    """Complete the text columns; invalid and inconsistent cells per file."""
    totals = {}
    for f in files:
        pairs = [_text_profile(c, f.profiles[c.slot], f.rows - f.nulls[c.slot], summaries.get(c.slot, SlotSummary()))
                 for c in f.cells if c.storage in ("object", "bool")]
        totals[f.number] = (sum(p[0] for p in pairs), sum(p[1] for p in pairs))
    return totals


def _numbers(cells: DataFrame, files: list[_File], moments: dict, summaries: dict[int, SlotSummary], lasting: str | None = None) -> None:
    """Quartiles, fences, histograms and repeated extremes of all numeric and date columns."""
    spark = cells.sparkSession
    profiles: dict[int, ColumnProfile] = {}
    for f in files:
        for c in f.cells:
            p = f.profiles[c.slot]
            if c.storage in ("int", "float") or c.storage == "object" and p.is_numeric_like:
                p.outliers = {"count": 0, "method": "IQR", "lower": None, "upper": None}
                if c.slot in moments:
                    profiles[c.slot] = p
                elif c.slot in summaries and summaries[c.slot].first_date:
                    p.stats = {"min_date": summaries[c.slot].first_date, "max_date": summaries[c.slot].last_date}
    if not profiles:
        return
    ranks = [(slot, rank) for slot in profiles for rank in _wanted_ranks(moments[slot].n, list(_QUARTERS))]
    wanted = spark.createDataFrame(ranks, "slot int, rank long").groupBy("slot").agg(F.collect_list("rank").alias("ranks"))
    counts = stage(cells.where("number is not null").groupBy("slot", F.col("number").alias("value")).agg(F.count("row").alias("n"))
                   .join(F.broadcast(wanted.select("slot")), "slot", "left_semi"), "number-counts")
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).join(F.broadcast(wanted), "slot").select("slot", "value", "n", "upto", F.explode("ranks").alias("rank"))
    found: dict[int, dict[int, float]] = {}
    for r in placed.where("rank < upto and rank >= upto - n").collect():
        found.setdefault(r.slot, {})[r.rank] = r.value
    bounds, wide, edges = [], [], {}
    for slot, p in profiles.items():
        m = moments[slot]
        fences, edges[slot], far = number_facts(p, m, [_interpolate(found[slot], m.n, q) for q in _QUARTERS])
        if fences or edges[slot]:
            bounds.append((slot, *(fences or (None, None)), (edges[slot] or [])[1:-1]))
        if far:
            wide.append((slot, *far))
    if bounds:
        table = F.broadcast(spark.createDataFrame(bounds, "slot int, lower double, upper double, edges array<double>"))
        value, n = F.col("value"), F.col("n")
        outside = F.coalesce((value < F.col("lower")) | (value > F.col("upper")), F.lit(False))
        above = [F.sum(F.when(value >= F.get("edges", F.lit(i)), n).otherwise(0)).alias(f"above{i}") for i in range(K.HISTOGRAM_BINS - 1)]
        for r in counts.join(table, "slot").groupBy("slot").agg(
                F.sum(n).alias("n"), F.sum(F.when(outside, n).otherwise(0)).alias("outside"), *above).collect():
            note_fences(profiles[r.slot], edges[r.slot], r.n, r.outside, [r[f"above{i}"] for i in range(K.HISTOGRAM_BINS - 1)])
    if wide:
        table = F.broadcast(spark.createDataFrame(wide, "slot int, lower double, upper double"))
        repeated = counts.join(table, "slot").where("value < lower or value > upper").where(F.col("n") >= K.SENTINEL_MIN_REPEATS)
        note_sentinels(repeated.select("slot", "value", "n"), profiles, lasting)


def _samples(cells: DataFrame, files: list[_File]) -> None:
    """Spellings of sentinel words, and the first cells that do not parse in columns of mixed formats."""
    spark = cells.sparkSession
    by_slot = {s: p for f in files for s, p in f.profiles.items()}
    worded = [(s,) for s, p in by_slot.items() if not p.is_numeric_like and p.sentinel_count]
    mixed = [(s,) for s, p in by_slot.items() if p.format_inconsistency]
    if worded:
        words = cells.join(F.broadcast(spark.createDataFrame(worded, "slot int")), "slot").where(is_sentinel_word(F.col("value")))
        for r in words.select("slot", strip(F.col("value")).alias("value")).distinct().orderBy("slot", "value").collect():
            by_slot[r.slot].sentinel_values.append(r.value)
        for s, in worded:
            by_slot[s].sentinel_values.sort()
    if mixed:
        bad = cells.join(F.broadcast(spark.createDataFrame(mixed, "slot int")), "slot").where("value is not null and number is null")
        place = F.row_number().over(Window.partitionBy("slot").orderBy("row", "value"))
        for r in bad.withColumn("place", place).where(F.col("place") <= K.SAMPLE_CELLS).orderBy("slot", "place").collect():
            by_slot[r.slot].non_castable_sample.append(r.value)


def _where_missing(cells: DataFrame) -> tuple[dict, dict]:
    """(slot, gap) -> count and mean of numbers, and -> sums over categories, where the column of the gap is empty."""
    gapped = cells.where(F.size("gaps") > 0).withColumn("gap", F.explode("gaps"))
    means = {(r.slot, r.gap): (r.n, r.a) for r in gapped.where("number is not null").where("kind <> 'object'")
             .groupBy("slot", "gap").agg(F.count("number").alias("n"), F.avg("number").alias("a")).collect()}
    key = F.when(F.length("text") > LONG_CELL, F.sha2("text", 256)).otherwise(F.col("text")).alias("key")
    long = F.coalesce(F.length("text") > LONG_CELL, F.lit(False)).alias("long")
    every = cells.where("text is not null").groupBy("slot", long, key).agg(F.count("row").alias("n"))
    empty = gapped.where("text is not null").groupBy("slot", "gap", long, key).agg(F.count("row").alias("m"))
    sums = empty.join(every, ["slot", "long", "key"]).groupBy("slot", "gap").agg(
        F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m") / F.col("n")).alias("s"))
    return means, {(r.slot, r.gap): (r.m, r.s) for r in sums.collect()}


def _association_tests(f: _File, moments: dict, means: dict, shares: dict, summaries: dict[int, SlotSummary]) -> dict:
    """(test, statistic, p) of every column of a file with enough gaps against every other column."""
    if f.rows < K.MISSINGNESS_MIN_ROWS:
        return {}
    tests = {}
    for g in f.cells:
        if f.nulls[g.slot] < K.MISSINGNESS_MIN_NULLS:
            continue
        for o in f.cells:
            if o.slot == g.slot or f.rows - f.nulls[o.slot] < K.MISSINGNESS_MIN_ROWS:
                continue
            if o.storage in ("int", "float") or o.storage == "bool" and not f.nulls[o.slot]:
                m = moments[o.slot]
                tests[g.name, o.name] = ("point_biserial", *point_biserial(
                    m.n, m.mean, m.std_pop, *means.get((o.slot, g.slot), (0, None))))
            elif o.slot in summaries:
                summary = summaries[o.slot]
                summary.missing["gap"], summary.missing_share["gap"] = shares.get((o.slot, g.slot), (0, 0.0))
                tests[g.name, o.name] = ("chi2", *chi_square(summary, "gap"))
    return tests
