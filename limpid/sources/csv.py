"""CSV source: header rules, malformed-row split, null tokens, storage-type inference."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.coerce import INTEGER_RE, NUMBER_RE, col, fold_null_tokens
from limpid.functions.constants import CSV_BOOL_WORDS, PREVIEW_ROWS
from limpid.session import aggregate_in_groups, stage
from limpid.sources.blocks import TASK_ROWS, split_records
from limpid.sources.tables import ROW_ID, data_columns, preview, with_file_row_id

_BAD = "__record"
_BAD_FLAG = "__malformed"


@dataclass
class CsvTable:
    """A parsed CSV: typed rows and the number of rows skipped for having too many fields."""

    df: DataFrame
    malformed_rows: int


def unique_names(header: list[str]) -> list[str]:
    """Column names of a header record: blanks are numbered, repeats get a suffix."""
    names: list[str] = []
    taken: set[str] = set()
    for i, raw in enumerate(header):
        base = raw if raw != "" else f"Unnamed: {i}"
        name, k = base, 0
        while name in taken:
            k += 1
            name = f"{base}.{k}"
        taken.add(name)
        names.append(name)
    return names


CSV_OPTIONS = {"mode": "PERMISSIVE", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
            "emptyValue": "", "nullValue": ""}


def _reader(spark: SparkSession, multi_line: bool):
    return spark.read.options(**CSV_OPTIONS, multiLine=multi_line)


def _files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Addresses of the files under a path, in order."""
    return sorted(spark.read.text(path).inputFiles())


def paths_of(files: list[str]) -> list[str]:
    """Paths that can be read, of addresses in which some characters are escaped."""
    return [unquote(f) for f in files]


def _first_record(spark: SparkSession, files: list[str], multi_line: bool) -> tuple[int, list[str]]:
    """(number of its file, cells) of the first record; files without any record come before it."""
    for k, file in enumerate(files):
        row = _reader(spark, multi_line).option("header", False).csv(unquote(file)).first()
        if row is not None and any(cell is not None for cell in row):
            cells = ["" if cell is None else cell for cell in row]
            return k, [cells[0].lstrip("\ufeff"), *cells[1:]]
    raise ValueError(f"no columns to read in {files}")


def scan_csv(
    spark: SparkSession, path: str | list[str], has_header: bool = True, multi_line: bool = True,
    block_bytes: int | None = None
) -> DataFrame:
    """All cells as text, null tokens folded, with a row id and a malformed flag per row.

    Spark marks records that are too long and too short alike. Only the long ones are malformed;
    short ones are padded with nulls. Commas inside quotes are removed before fields are counted.
    Line breaks inside quotes belong to the cell. A file of more than ``block_bytes`` (default: the
    session's largest partition of a file) is read by as many tasks as it has blocks, smaller ones by
    one task each; rows and ids are the same. ``multi_line=False`` splits files at every line
    break, for data known to have none in quotes. A file whose header differs from that of the first
    file is refused.
    """
    files = _files(spark, path)
    _, header = _first_record(spark, files, multi_line)
    names = unique_names(header) if has_header else [f"col_{i}" for i in range(len(header))]
    large = _large_files(spark, files, block_bytes) if multi_line else []
    parts = []
    if len(large) < len(files):
        small = sorted(set(files) - set(large))
        parts.append(_scan_whole(spark, small, files, names, has_header, header, multi_line))
    if large:
        parts.append(_scan_blocks(spark, large, files, names, has_header, header, block_bytes))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def block_size(spark: SparkSession) -> int:
    """Bytes of the largest part of a file that one task reads."""
    size, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(size) << 10 * " kmgt".index(unit or " ")


def _large_files(spark: SparkSession, files: list[str], block_bytes: int | None) -> list[str]:
    """Files of more than one block. Only their sizes are read."""
    limit = block_size(spark) if block_bytes is None else block_bytes
    sizes = spark.read.format("binaryFile").load(paths_of(files)).where(F.col("length") > limit).select("path")
    plain = lambda f: re.sub("^file:/+", "file:/", f)
    found = {plain(r.path) for r in sizes.collect()}
    return [f for f in files if plain(unquote(f)) in found]


def _scan_whole(spark, files: list[str], every: list[str], names: list[str], has_header: bool, header: list[str], multi_line: bool) -> DataFrame:
    """Cells by Spark's reader, a file per task unless every line is a record."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(_BAD, T.StringType())])
    # Spark compares the names of every file with the schema, unless names had to be made up
    raw = (_reader(spark, multi_line).schema(schema).option("header", has_header)
           .option("enforceSchema", not has_header or names != header)
           .option("columnNameOfCorruptRecord", _BAD).option("columnPruning", False).csv(paths_of(files)))
    in_file = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(TASK_ROWS))
    raw = with_file_row_id(raw, in_file, every)
    return raw.select(col(ROW_ID), *[fold_null_tokens(col(n)).alias(n) for n in names],
                      F.coalesce(field_count(col(_BAD)) > len(names), F.lit(False)).alias(_BAD_FLAG))


def _scan_blocks(spark, files: list[str], every: list[str], names: list[str], has_header: bool, header: list[str],
                 block_bytes: int | None) -> DataFrame:
    """Cells of records that were found by blocks."""
    records = split_records(spark, paths_of(files), block_bytes)
    # cells are parsed under made-up names; those of the header may hold any character
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), f"{_BAD} string"])
    cells = F.from_csv("text", schema, CSV_OPTIONS | {"multiLine": "true", "columnNameOfCorruptRecord": _BAD})
    parsed = records.withColumn("cells", cells)
    if has_header:
        if names == header:
            first = F.array(*[F.coalesce(F.col(f"cells.c{i}"), F.lit("")) for i in range(len(names))])
            odd = parsed.where("number = 0").where(
                (F.regexp_replace(F.array_join(first, "\x00"), "^\ufeff", "") != "\x00".join(names)) | (field_count(F.col("text")) != len(names)))
            other = odd.select("file").first()
            if other is not None:
                raise ValueError(f"the header of {other.file} is not that of the first file: {names}")
        parsed = parsed.where("number > 0")
    position = F.col("number") - 1 if has_header else F.col("number")
    bad = F.coalesce(field_count(F.col(f"cells.{_BAD}")) > len(names), F.lit(False))
    return with_file_row_id(parsed, position, every, F.col("file")).select(
        col(ROW_ID), *[fold_null_tokens(F.col(f"cells.c{i}")).alias(n) for i, n in enumerate(names)], bad.alias(_BAD_FLAG))


def field_count(record: Column) -> Column:
    """Number of fields of a record."""
    # possessive: a quoted cell of any length is passed in one step, without a stack frame per character
    unquoted = F.regexp_replace(record, '"(?:[^"]++|"")*+"', "")
    return 1 + F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))


def infer_storage(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Spark type of each text column, by one aggregate over match counts.

    Integers need every cell filled; an integer column with gaps is double, like an empty one.
    """
    columns = columns or data_columns(df)
    wanted = {"rows": F.count(F.lit(1))}
    for i, name in enumerate(columns):
        c = col(name)
        wanted[f"n{i}"] = F.count(c)
        wanted[f"i{i}"] = F.count_if(c.rlike(INTEGER_RE) & c.try_cast("bigint").isNotNull())
        wanted[f"f{i}"] = F.count_if(c.rlike(NUMBER_RE))
        wanted[f"b{i}"] = F.count_if(c.isin(*CSV_BOOL_WORDS))
    counts = aggregate_in_groups(df, wanted)
    types = {}
    for i, name in enumerate(columns):
        filled, rows = counts[f"n{i}"], counts["rows"]
        if rows == 0:
            types[name] = "string"
        elif filled == rows and counts[f"i{i}"] == filled:
            types[name] = "bigint"
        elif counts[f"f{i}"] == filled:
            types[name] = "double"
        elif counts[f"b{i}"] == filled:
            types[name] = "boolean"
        else:
            types[name] = "string"
    return types


def apply_storage(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def typed(name: str):
        kind = types.get(name, "")
        return col(name).try_cast(kind).alias(name) if kind not in ("", "string") else col(name)

    return df.select(*[typed(n) for n in df.columns])


def read_csv(
    spark: SparkSession, path: str | list[str], has_header: bool = True, multi_line: bool = True,
    block_bytes: int | None = None
) -> CsvTable:
    """Parse a CSV file or folder into a typed table.

    The text is parsed once and staged as parquet in the shared folder, because every later step
    makes several passes and would otherwise parse the text again.
    """
    staged = stage(scan_csv(spark, path, has_header, multi_line, block_bytes), "csv")
    good = staged.filter(~F.col(_BAD_FLAG)).drop(_BAD_FLAG)
    malformed = staged.filter(F.col(_BAD_FLAG)).count()
    return CsvTable(apply_storage(good, infer_storage(good)), malformed)


def preview_csv(spark: SparkSession, path: str, has_header: bool = True, rows: int = PREVIEW_ROWS,
                multi_line: bool = True) -> DataFrame:
    """First records of a CSV file or folder, typed by themselves.

    Files are read in their order, four times as many in each step, until there are enough rows.
    """
    files = _files(spark, path)
    start, _ = _first_record(spark, files, multi_line)
    count = 1
    while True:
        scan = scan_csv(spark, paths_of(files[start:start + count]), has_header, multi_line)
        top = preview(scan.filter(~F.col(_BAD_FLAG)).drop(_BAD_FLAG), rows)
        found = top.collect()                                   # at most ``rows`` rows
        if len(found) == rows or start + count >= len(files):
            head = spark.createDataFrame(found, top.schema)
            return apply_storage(head, infer_storage(head))
        count *= 4
