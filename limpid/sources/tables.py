"""Table sources and sinks other than CSV parsing: zones, parquet, cleaned output, preview."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions.coerce import col
from limpid.functions.constants import PREVIEW_ROWS

ROW_ID = "__row_id"
# Row ids are ordinal of the file * 2^40 + position in the file.
_FILE_SPAN = 1 << 40
# Up to this many files the ordinals travel as a literal map; beyond it they are joined.
_MAP_FILES = 256


def data_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[str]:
    return [c for c in df.columns if c != row_id]


def with_file_row_id(df: DataFrame, position: Column, files: list[str] | None = None, path: Column | None = None) -> DataFrame:
    """Add a long row id that grows with the file name and the position inside the file.

    ``df`` must read files directly, unless ``files`` lists them and ``path`` tells the file of a
    row. The id does not depend on how files are split or packed into
    partitions, so a lost task that runs again gives the same ids.
    """
    files = sorted(files or df.inputFiles())
    if len(files) <= 1:
        return df.withColumn(ROW_ID, position)
    # the list says file:///x where the metadata column says file:/x
    files = [re.sub("^file:/+", "file:/", f) for f in files]
    path = F.regexp_replace(F.col("_metadata.file_path") if path is None else path, "^file:/+", "file:/")
    if len(files) <= _MAP_FILES:
        pairs = [F.lit(x) for i, f in enumerate(files) for x in (f, i)]
        return df.withColumn(ROW_ID, F.create_map(*pairs)[path].cast("long") * _FILE_SPAN + position)
    ordinals = df.sparkSession.createDataFrame(list(enumerate(files)), "__file int, __path string")
    return (
        df.withColumn("__path", path).withColumn("__position", position)
        .join(ordinals, "__path", "left")
        .withColumn(ROW_ID, F.col("__file").cast("long") * _FILE_SPAN + F.col("__position"))
        .drop("__path", "__position", "__file")
    )


def read_parquet(spark: SparkSession, path: str, row_id: bool = True) -> DataFrame:
    """Parquet table with a stable row id taken from the file's own row index."""
    df = spark.read.parquet(path)
    return with_file_row_id(df, F.col("_metadata.row_index")) if row_id else df


def raw_path(zone: str, file_id: str, filename: str) -> str:
    return f"{zone.rstrip('/')}/{file_id}/{filename}"


def cleaned_path(zone: str, file_id: str, run_id: str) -> str:
    return f"{zone.rstrip('/')}/{file_id}/{run_id}/cleaned"


def write_raw(df: DataFrame, zone: str, file_id: str, filename: str) -> str:
    """Land a table in the raw zone as CSV with a header."""
    path = raw_path(zone, file_id, filename)
    _write_csv(df, path)
    return path


def write_cleaned(df: DataFrame, zone: str, file_id: str, run_id: str, fmt: str = "csv") -> str:
    """Write a cleaned table in row order, without its row id; returns the folder written.

    Rows are dealt to the files by ranges of the row id, so the files follow each other in row order.
    """
    path = cleaned_path(zone, file_id, run_id) + ("" if fmt == "csv" else f".{fmt}")
    if ROW_ID in df.columns:
        df = df.orderBy(ROW_ID)
    if fmt == "csv":
        _write_csv(df, path)
    else:
        df.drop(ROW_ID).write.mode("overwrite").format(fmt).save(path)
    return path


def _write_csv(df: DataFrame, path: str) -> None:
    (df.drop(ROW_ID).write.mode("overwrite")
     .option("header", True).option("escape", '"').option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, row_id: str = ROW_ID) -> DataFrame:
    """First rows in row order; a top-k per task, nothing is sorted as a whole."""
    if row_id in df.columns:
        df = df.orderBy(col(row_id))
    return df.limit(rows).drop(row_id) if row_id == ROW_ID else df.limit(rows)
