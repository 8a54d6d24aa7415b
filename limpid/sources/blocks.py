"""CSV records of files that are read by blocks, also where quoted cells hold line breaks.

A block of a file cannot know whether it begins inside quotes. So each line is given what it does to
either beginning: whether a quoted cell is open at its end if none is open before it, and if one is.
Lines that end the same way for both settle the matter; of the others only the number of reversals
since counts. A block is summed up to the same two answers, one row per block carries them on
through the file, and then every line knows whether a record begins in it and which number it has.
No task reads more than its blocks. Only records of several lines are put together by a grouping.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limpid.session import stage

# Rows of one partition are counted in the low bits of a monotonically increasing id.
TASK_ROWS = (1 << 33) - 1

# What is left of a quoted cell behind its opening quote, and behind its end up to the next comma; every
# group is possessive, so a cell of any length is passed without a stack frame per character.
_CELL = r'(?:[^"]++|"")*+'
_REST = r"[^,]*+"
_FIELDS = rf'(?:(?:"{_CELL}"{_REST}|[^",]{_REST}|),)*+'
# one match for each field of a record but the last
FIELD_END = rf'\G(?:"{_CELL}"{_REST}|[^",]{_REST}|),'
_OPEN_AFTER_NONE = rf'\A{_FIELDS}"{_CELL}\z'
_OPEN_AFTER_OPEN = rf'\A{_CELL}(?:\z|"{_REST},{_FIELDS}"{_CELL}\z)'


@contextmanager
def _split_size(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Largest block of a file while a scan is planned; None leaves the session's."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if size:
        spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, line, text, after_none, after_open) of every line.

    ``block`` is the byte at which the block begins, ``line`` grows inside a block.
    """
    raw = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(TASK_ROWS)).alias("line"), F.col("value").alias("text"))
    quoted = F.contains("text", F.lit('"'))
    return raw.withColumns({
        "after_none": F.when(quoted, _bare("text").rlike(_OPEN_AFTER_NONE)).otherwise(False),
        "after_open": F.when(quoted, _bare("text").rlike(_OPEN_AFTER_OPEN)).otherwise(True)})


def _bare(text: str | Column) -> Column:
    """A line without the carriage return that belongs to its end."""
    return F.regexp_replace(text, r"\r\z", "")


def _with_state(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add the composed answers from the first row of a group to the end of each row.

    ``known`` is the state after the row if some row up to it settles it, else null; ``turned`` tells
    whether the number of reversals since that row, or since the first one, is odd.
    """
    settles = F.col("after_none") == F.col("after_open")
    turns = F.col("after_none") & ~F.col("after_open")
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("__turns", F.sum(turns.cast("long")).over(within))
    at = F.last(F.when(settles, F.struct(F.col("after_none").alias("open"), F.col("__turns").alias("turns"))), ignorenulls=True).over(within)
    return (counted.withColumn("__at", at)
            .withColumn("turned", (F.col("__turns") - F.coalesce("__at.turns", F.lit(0))) % 2 == 1)
            .withColumn("known", F.col("__at.open")).drop("__turns", "__at"))


def _state(known: Column, turned: Column, before: Column) -> Column:
    """Whether a quoted cell is open: the settled or the earlier state, reversed by an odd number of turns."""
    return F.coalesce(known, before) != turned


def split_records(spark: SparkSession, files: list[str], block_bytes: int | None = None) -> DataFrame:
    """(file, number, text) of every record of ``files``; numbers of a file are gapless from 0.

    A record is a line, or several if quoted cells hold line breaks, without its line end. Empty
    lines between records are no records. Quotes count as by the CSV reader: a cell is quoted if it
    begins with a quote, two quotes inside it are one character, and what follows its end belongs
    to the cell up to the next comma. A file that ends inside quotes ends its last record there.
    """
    with _split_size(spark, block_bytes):
        placed = _with_state(_lines(spark, files), ["file", "block"], "line")
        after = {open_: _state(F.col("known"), F.col("turned"), F.lit(open_)) for open_ in (False, True)}
        order = Window.partitionBy("file", "block").orderBy("line")
        # whether a record begins in a line, and how many did so far in its block, for both beginnings of the block
        begins = {open_: ~F.coalesce(F.lag(after[open_]).over(order), F.lit(open_)) for open_ in (False, True)}
        marked = placed.select("file", "block", "line", "text", "known", "turned", (_bare("text") != "").alias("filled"),
                               begins[False].alias("begins_none"), begins[True].alias("begins_open"))
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        # written once: both passes see the same blocks, whatever becomes of the executors
        marked = stage(marked.withColumns({
            f"count_{name}": F.sum((F.col(f"begins_{name}") & F.col("filled")).cast("long")).over(so_far) for name in ("none", "open")}), "csv-lines")
    last = F.max_by(F.struct("known", "turned", "count_none", "count_open"), "line")
    ends = marked.groupBy("file", "block").agg(last.alias("end")).select(
        "file", "block", "end.count_none", "end.count_open",
        _state(F.col("end.known"), F.col("end.turned"), F.lit(False)).alias("after_none"),
        _state(F.col("end.known"), F.col("end.turned"), F.lit(True)).alias("after_open"))
    # through the file, one row per block: the state before it, and the records that began earlier
    in_file = Window.partitionBy("file").orderBy("block")
    through = _with_state(ends, ["file"], "block")
    before = F.coalesce(F.lag(_state(F.col("known"), F.col("turned"), F.lit(False))).over(in_file), F.lit(False))
    counted = through.withColumn("open", before).withColumn("count", F.when(F.col("open"), F.col("count_open")).otherwise(F.col("count_none")))
    carried = counted.select("file", "block", "open", (F.sum("count").over(in_file) - F.col("count")).alias("earlier"))
    pick = lambda name: F.when(F.col("open"), F.col(f"{name}_open")).otherwise(F.col(f"{name}_none"))
    numbered = marked.join(carried, ["file", "block"]).select(
        "file", "block", "line", "text", (F.col("earlier") + pick("count") - 1).alias("number"), pick("begins").alias("begins"),
        (pick("begins") & ~_state(F.col("known"), F.col("turned"), F.col("open"))).alias("whole"), "filled").where("filled or not begins")
    whole = numbered.where("whole").select("file", "number", _bare("text").alias("text"))
    parts = numbered.where("not whole").groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("block", "line", "text"))).alias("lines"))
    several = parts.select("file", "number", _bare(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("text"))
    return whole.unionByName(several)
