"""Drop flags as bitmaps: one row per operation and bucket of row numbers, counted without the rows.

A bucket holds 32,768 consecutive row numbers, so a mask takes one bit per row and operation, whatever
the width of the table. The effect of any choice of strategies is the number of bits in the union of
its masks, bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.coerce import col
from limpid.operators.impact import DUPLICATE, Strategies
from limpid.session import count_rows, stage
from limpid.sources.tables import ROW_ID, data_columns

# The mask of all rows, from which their number is read.
ALL_ROWS = "rows"
# rows per range that one task numbers
_RANGE_ROWS = 100_000


def numbered(df: DataFrame, name: str, range_rows: int = _RANGE_ROWS, row_id: str = ROW_ID) -> DataFrame:
    """Add the position of each row by row id, from 0: ranges of row ids are numbered apart, after the counts of those before."""
    ranges = max(1, -(-count_rows(df) // range_rows))
    dealt = stage(df.repartitionByRange(ranges, col(row_id)).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = {r[0]: r[1] for r in dealt.groupBy("__range").count().collect()}
    starts, total = [], 0
    for k in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(k, 0)
    within = Window.partitionBy("__range").orderBy(col(row_id))
    start = F.get(F.array(*[F.lit(n).cast("long") for n in starts]), F.col("__range"))
    return dealt.withColumn(name, start + F.row_number().over(within) - 1).drop("__range")


def masks_of_numbers(flagged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., operation, bucket, mask) of rows (keys..., operation, number): the numbers, from 1, that an operation flags.

    A mask is an aggregate of fixed size, combined before the shuffle.
    """
    keys = keys or []
    return (flagged.groupBy(*keys, "operation", F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("mask")))


def flag_masks(flags: DataFrame, row_id: str = ROW_ID, dense: bool = False) -> DataFrame:
    """(operation, bucket, mask) of per-row flags (row id and one boolean per operation).

    Rows are numbered from 0 in the order of their ids first, unless ``dense`` says that the ids are
    such numbers already. An operation that flags no row has no mask; an empty table has none at all.
    """
    names = data_columns(flags, row_id)
    placed = flags.withColumn("number", col(row_id).cast("long")) if dense else numbered(flags, "number", row_id=row_id)
    cells = [x for n in names for x in (F.lit(n), F.coalesce(col(n), F.lit(False)))]
    # buckets begin at numbers that leave 1 when divided by their size
    long = placed.select((F.col("number") + 1).alias("number"), F.stack(F.lit(len(names) + 1), F.lit(ALL_ROWS), F.lit(True), *cells).alias("operation", "flag"))
    return masks_of_numbers(long.where("flag").drop("flag"))


def _chosen_operations(chosen: Strategies) -> dict[str, str]:
    """Kind of each mask that a choice counts."""
    kinds = {ALL_ROWS: ALL_ROWS}
    kinds |= {f"null_{n}": "null" for n, s in chosen.nulls.items() if s == "drop_row"}
    kinds |= {f"outlier_{n}": "outlier" for n, s in chosen.outliers.items() if s == "remove"}
    return kinds | ({DUPLICATE: DUPLICATE} if chosen.duplicates == "drop" else {})


def impacts_of_masks(masks: DataFrame, choices: dict[str, Strategies]) -> DataFrame:
    """The row of ``drop_impact`` for each of several choices, with its name as ``choice``, from stored masks."""
    pairs = [(name, operation, kind) for name, chosen in choices.items() for operation, kind in _chosen_operations(chosen).items()]
    # a row per choice and operation, all of which the caller has written down
    wanted = F.broadcast(masks.sparkSession.createDataFrame(pairs, "choice string, operation string, kind string"))
    bits = lambda kind: F.sum(F.when(F.col("kind") == kind, F.bitmap_count("mask")).otherwise(0))
    buckets = masks.join(wanted, "operation").groupBy("choice", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg(F.when(F.col("kind") != ALL_ROWS, F.col("mask")))).alias("dropped"),
        *[bits(k).alias(k) for k in (ALL_ROWS, "null", "outlier", DUPLICATE)])
    total = lambda name, to: F.sum(name).cast("long").alias(to)
    parts = buckets.groupBy("choice").agg(
        total(ALL_ROWS, "rows_before"), total("dropped", "rows_dropped"), total("null", "null_drops"),
        total("outlier", "outlier_drops"), total(DUPLICATE, "duplicate_drops"))
    each = F.col("null_drops") + F.col("outlier_drops") + F.col("duplicate_drops")
    return parts.select(
        "choice", "rows_before", "rows_dropped", (F.col("rows_before") - F.col("rows_dropped")).alias("rows_after"),
        "null_drops", "outlier_drops", "duplicate_drops",
        F.greatest(F.lit(0).cast("long"), each - F.col("rows_dropped")).alias("overlap_saved"))


def impact_of_masks(masks: DataFrame, chosen: Strategies) -> DataFrame:
    """The row of ``drop_impact``, from stored masks; all zero for a table without rows."""
    names = ["rows_before", "rows_dropped", "rows_after", "null_drops", "outlier_drops", "duplicate_drops", "overlap_saved"]
    return impacts_of_masks(masks, {"": chosen}).agg(*[F.coalesce(F.max(n), F.lit(0)).cast("long").alias(n) for n in names])


def overlaps_of_masks(masks: DataFrame) -> DataFrame:
    """(operation, other, rows): how many rows two operations both flag, for every pair that shares one."""
    a = masks.where(F.col("operation") != ALL_ROWS)
    b = a.select(F.col("operation").alias("other"), "bucket", F.col("mask").alias("__mask"))
    both = a.join(b, "bucket").where("operation < other").select(
        "operation", "other", "bucket", F.explode(F.array("mask", "__mask")).alias("mask"))
    return (both.groupBy("operation", "other", "bucket").agg(F.bitmap_count(F.expr("bitmap_and_agg(mask)")).alias("n"))
            .groupBy("operation", "other").agg(F.sum("n").cast("long").alias("rows")).where("rows > 0"))
