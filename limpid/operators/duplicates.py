"""Full-row and subset duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.coerce import col
from limpid.sources.tables import ROW_ID, data_columns


def row_key(df: DataFrame, columns: list[str]) -> Column:
    """128-bit key of a row: equal rows have equal keys, and -0.0 counts as 0.0.

    Counting and flagging shuffle this key instead of whole rows. Two unequal rows would have to
    agree in two independent 64-bit hashes; among 10^12 rows the chance of any such pair is below 10^-14.
    The gaps are hashed as well, because a hash alone passes over nulls.
    """
    def plain(c: str) -> Column:
        return col(c) + 0.0 if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else col(c)

    cells = [x for c in columns for x in (plain(c), col(c).isNull())]
    return F.struct(F.xxhash64(*cells).alias("h"), F.xxhash64(F.lit("second"), *cells).alias("k"))


def count_duplicates(df: DataFrame, row_id: str | None = ROW_ID, rows: int | None = None) -> int:
    """Rows that repeat an earlier row in all columns."""
    columns = data_columns(df, row_id)
    if not columns:
        return 0
    copies = df.select(row_key(df, columns).alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    return copies.agg(F.sum(F.col("__n") - 1)).first()[0] or 0


def drop_duplicates(
    df: DataFrame, subset: list[str] | None = None, keep: str = "first", row_id: str | None = ROW_ID
) -> DataFrame:
    """Keep one row per group of equal rows.

    Over all columns rows are compared by their 128-bit key, and only the row ids of copies meet the
    rows again: whole rows are shuffled only if the copies are too many to be sent to every task. Without a
    row id one grouping over all columns does it. Over a subset the kept row is chosen by ``row_id``;
    every task first reduces its rows to one per key (group limit), so a hot key sends one row per task.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    has_id = row_id is not None and row_id in df.columns
    if not subset:
        columns = data_columns(df, row_id)
        if not has_id:
            return df.dropDuplicates()
        return df.join(copy_ids(df, columns, keep, row_id), row_id, "left_anti").select(*[col(c) for c in df.columns])
    missing = [c for c in subset if c not in df.columns]
    if missing:
        raise ValueError(f"duplicate subset names unknown columns {missing}")
    if not has_id:
        raise ValueError("deduplication on a subset needs a row id column to order the rows")
    order = col(row_id).asc() if keep == "first" else col(row_id).desc()
    # full rows break ties of a repeated row id, so the result does not depend on partitioning
    rest = [col(c) for c in df.columns if c != row_id and c not in subset]
    ranked = df.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*[col(c) for c in subset]).orderBy(order, *rest)))
    return ranked.filter(F.col("__rank") <= 1).drop("__rank")


def copy_ids(df: DataFrame, columns: list[str], keep: str = "first", row_id: str = ROW_ID) -> DataFrame:
    """Row ids of all rows that are equal in ``columns`` to the one of their group that is kept."""
    pick = F.min if keep == "first" else F.max
    keyed = df.select(col(row_id), row_key(df, columns).alias("__key"))
    groups = (keyed.groupBy("__key").agg(pick(col(row_id)).alias("__kept"), F.count(F.lit(1)).alias("__n"))
              .where("__n > 1").select("__key", "__kept"))
    return keyed.join(groups, "__key").where(col(row_id) != F.col("__kept")).select(col(row_id))


def mark_copies(keyed: DataFrame, flag: str, row_id: str = ROW_ID) -> DataFrame:
    """Replace ``__key`` (see ``row_key``) by ``flag``: true for every row of a key but the first.

    The first row id per key comes from a combined aggregate; marking is a join on the row id, which
    is unique and therefore even, instead of a window over groups of any size. Only what the caller
    selected beside the key travels.
    """
    firsts = (keyed.groupBy("__key").agg(F.min(col(row_id)).alias("__first"))
              .select("__first", F.lit(False).alias("__copy")))
    return keyed.join(firsts, col(row_id) == F.col("__first"), "left").select(
        *[col(c) for c in keyed.columns if c != "__key"], F.coalesce(F.col("__copy"), F.lit(True)).alias(flag))
