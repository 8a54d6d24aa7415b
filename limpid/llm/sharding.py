"""Shards along a Hilbert curve over several metadata columns.

Each column is quantised by its own distribution, the levels of a row are one point of a grid, and
rows are ordered by the point's place on the Hilbert curve. Neighbours on the curve are neighbours in
every dimension, so a run of the order covers a small box: the minimum and maximum of each column in
a file prune files for filters on any of the columns, not only on a leading sort key. Runs are cut by
row numbers, so shards differ by at most one row (law ``rows``).

Only fixed-size summaries reach the driver: the bounds of the levels and of the blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SHARDS = 40
# levels per dimension are 2 ** BITS; with four dimensions an index has 32 bits
BITS = 8
# blocks of the order that are numbered independently; each holds about 1 / BLOCKS of the rows
BLOCKS = 1024
_SKETCH = 10_000


@dataclass(frozen=True)
class Grid:
    """Bounds of the levels per dimension: (column, number of leading characters to skip, bounds)."""

    dimensions: tuple[tuple[str, int, tuple[float, ...]], ...]
    bits: int = BITS


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _as_number(df: DataFrame, name: str, skip: int) -> Column:
    """A number that keeps the order of the column; of a text, the six octets after ``skip`` characters."""
    if not _is_text(df, name):
        return F.col(name).cast("double")
    octets = F.rpad(F.hex(F.substring(F.encode(F.substring(F.col(name), skip + 1, 6), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(octets, 16, 10).cast("double")


def fit_grid(df: DataFrame, dimensions: list[str], bits: int = BITS) -> Grid:
    """Quantile bounds of every dimension over all rows: at most 2 ** bits - 1 numbers each.

    Texts are compared by the octets after the prefix that all of them share.
    """
    texts = [n for n in dimensions if _is_text(df, n)]
    skip = dict.fromkeys(dimensions, 0)
    if texts:
        ends = df.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(texts) for k, f in (("a", F.min), ("z", F.max))]).first()
        for i, n in enumerate(texts):
            low, high = ends[f"a{i}"] or "", ends[f"z{i}"] or ""
            while skip[n] < min(len(low), len(high)) and low[skip[n]] == high[skip[n]]:
                skip[n] += 1
    levels = 1 << bits
    cuts = [k / levels for k in range(1, levels)]
    found = df.agg(*[F.percentile_approx(_as_number(df, n, skip[n]), cuts, _SKETCH).alias(f"q{i}")
                     for i, n in enumerate(dimensions)]).first()
    return Grid(tuple((n, skip[n], tuple(sorted(v for v in set(found[f"q{i}"] or ()) if math.isfinite(v)))) for i, n in enumerate(dimensions)), bits)


def _numbers(values, kind: str) -> Column:
    return F.expr(f"array({', '.join(f'CAST({v!r} AS {kind})' for v in values)})")


def _level(value: Column, bounds: tuple[float, ...]) -> Column:
    """Number of the sorted bounds that are not above the value, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0).cast("bigint")
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    table = _numbers(bounds, "DOUBLE")
    # the value is bound to a variable, so it is computed once and not once per step
    found = F.transform(F.array(value), lambda v: F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= v, at + step).otherwise(at)))
    return F.get(found, F.lit(0)).cast("bigint")


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Place of a grid point on the Hilbert curve (Skilling, "Programming the Hilbert curve", 2004)."""
    n = len(levels)
    number = lambda x: F.lit(x).cast("bigint")
    pairs = lambda low: [(bit, i) for bit in range(bits - 1, low - 1, -1) for i in range(n)]

    def turn(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        here, first = F.get(x, i), F.get(x, F.lit(0))
        change = F.when(here.bitwiseAND(q) != 0, q - 1).otherwise(first.bitwiseXOR(here).bitwiseAND(q - 1))
        both = here.bitwiseAND(q) == 0
        return F.transform(x, lambda v, j: F.when((j == 0) | (both & (j == i)), F.when(
            (i == 0) & both, v).otherwise(v.bitwiseXOR(change))).otherwise(v))

    point = F.array(*levels)
    if bits > 1:
        steps = F.array(*[F.struct(number(1 << bit).alias("q"), F.lit(i).alias("i")) for bit, i in pairs(1)])
        point = F.aggregate(steps, point, turn)
    # Gray code along the dimensions: the running exclusive-or of the coordinates
    gray = F.aggregate(point, F.array().cast("array<bigint>"), lambda acc, v: F.concat(
        acc, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), number(0))))))
    # the last coordinate says which low bits of all coordinates are flipped
    masks = F.array(*[number(1 << bit) for bit in range(bits)])
    flips = lambda g: F.aggregate(masks, number(0), lambda t, q: F.when(
        F.element_at(g, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    spots = F.array(*[F.struct(number(1 << bit).alias("q"), F.lit(i).alias("i")) for bit, i in pairs(0)])
    woven = lambda g, f: F.aggregate(spots, number(0), lambda acc, p: acc * 2 + F.when(
        F.get(g, p["i"]).bitwiseXOR(f).bitwiseAND(p["q"]) != 0, 1).otherwise(0))
    bound = F.transform(F.array(gray), lambda g: F.struct(g.alias("g"), flips(g).alias("f")))
    return F.transform(bound, lambda s: woven(s["g"], s["f"]))[0]


def with_curve(df: DataFrame, grid: Grid, to: str = "curve_index") -> DataFrame:
    """Add the place of each row on the curve. A null in a dimension is its lowest level."""
    levels = [_level(_as_number(df, n, skip), bounds) for n, skip, bounds in grid.dimensions]
    return df.withColumn(to, hilbert_index(levels, grid.bits))


def shard_rows(df: DataFrame, dimensions: list[str], shards: int = SHARDS, bits: int = BITS,
               ties: list[Column] | None = None) -> DataFrame:
    """``df`` with curve_index, shard (0 to shards - 1) and slot (place in the shard, gapless from 0).

    Shards are consecutive runs of the curve order and differ by at most one row. Rows at one point
    of the curve are ordered by ``ties`` (default: all columns that can be sorted); rows equal in all of them may take
    each other's places. The order is numbered in up to BLOCKS blocks of nearly equal size, cut at
    quantiles of the index, so no task numbers more than a small share of the rows; the counts of
    the blocks are the only thing the driver adds up. An empty table gives an empty table.
    """
    grid = fit_grid(df, dimensions, bits)
    placed = with_curve(df, grid)
    narrow = with_curve(df.select(*dict.fromkeys(dimensions)), grid).select("curve_index")
    cuts = narrow.agg(F.percentile_approx("curve_index", [k / BLOCKS for k in range(1, BLOCKS)], _SKETCH)).first()[0]
    bounds = tuple(sorted(set(cuts or ())))
    block = _level(F.col("curve_index"), bounds)
    counts = {r[0]: r[1] for r in narrow.groupBy(block.alias("block")).agg(F.count(F.lit(1))).collect()}
    total, starts = 0, []
    for k in range(len(bounds) + 1):
        starts.append(total)
        total += counts.get(k, 0)
    order = ties if ties is not None else [F.col(c) for c, kind in df.dtypes if not kind.startswith("map")]
    within = Window.partitionBy("__block").orderBy("curve_index", *order)
    rank = F.get(_numbers(starts, "BIGINT"), F.col("__block").cast("int")) + F.row_number().over(within) - 1
    ranked = placed.withColumn("__block", block).withColumn("__rank", rank)
    shard = F.expr(f"(__rank * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"((__rank * {shards}L) div {max(total, 1)}L * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return (ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__rank") - first)
            .drop("__block", "__rank"))


def write_shards(df: DataFrame, path: str, dimensions: list[str], shards: int = SHARDS, rows_per_file: int = 100_000,
                 bits: int = BITS) -> None:
    """Write ``df`` as parquet, a folder per shard and files of consecutive runs of the curve order.

    A file covers a small box of the dimensions, so its column statistics prune it for most filters.
    """
    placed = shard_rows(df, dimensions, shards, bits).withColumn("run", F.expr(f"slot div {rows_per_file}L"))
    (placed.repartition("shard", "run").sortWithinPartitions("shard", "run", "slot")
     .drop("curve_index", "slot").write.partitionBy("shard", "run").parquet(path))


DIMENSIONS = ["lang", "source", "n_chars", "doc_id"]


def op2_hilbert_sharding(spark, folder: str) -> DataFrame:
    """Shard and slot of all documents along the curve over language, source, length and id."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", "lang", "source", "n_chars",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"))
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = shard_rows(docs, DIMENSIONS, ties=ties)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve_index")


QUERIES = {"op2_hilbert_sharding": op2_hilbert_sharding}
