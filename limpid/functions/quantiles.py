"""Exact quantiles of many numeric expressions with bounded memory.

``percentile`` keeps a map of every distinct value of a column in one reducer, which does not
survive a high-cardinality column of a large table. Here each round is one scan that counts rows
per value bucket with map-side combine, so a task holds a bounded number of counters and the driver
receives the same amount. The bucket that holds a wanted rank becomes the next range;
its smallest and largest value come along, so a range made of one repeated value (a hot value)
ends at once. The first round buckets on a logarithmic scale and the following ones linearly,
which bounds the number of rounds by the bits of a double (about six), whatever the distribution.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Buckets per range, fewer when there are many ranges: the counts of a round go to the driver.
BUCKETS = 4096
MIN_BUCKETS = 64
ROUND_COUNTERS = 262_144
_MAX = 1.7976931348623157e308


def _wanted_ranks(n: int, probabilities: list[float]) -> list[int]:
    ranks = set()
    for p in probabilities:
        position = p * (n - 1)
        ranks.add(math.floor(position))
        ranks.add(math.ceil(position))
    return sorted(ranks)


def _interpolate(values: dict[int, float], n: int, p: float) -> float:
    position = p * (n - 1)
    low, high = math.floor(position), math.ceil(position)
    if low == high:
        return values[low]
    fraction = position - low
    return values[low] + (values[high] - values[low]) * fraction


def _log_scale(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def _py_log_scale(x: float) -> float:
    return math.copysign(math.log1p(abs(x)), x)


@dataclass(frozen=True)
class _Range:
    """Values of one column known to hold wanted ranks: ``below`` rows are smaller than ``low``."""

    low: float
    high: float
    count: int
    below: int
    ranks: tuple[int, ...]
    log: bool


def _settle(r: _Range, found: dict[int, float]) -> _Range | None:
    """Read off ranks at the ends of a range; what is left needs another round."""
    rest = []
    for rank in r.ranks:
        if r.low == r.high or rank == r.below:
            found[rank] = r.low
        elif rank == r.below + r.count - 1:
            found[rank] = r.high
        else:
            rest.append(rank)
    return replace(r, ranks=tuple(rest)) if rest else None


def _bucket_counts(df: DataFrame, columns: list[Column], ranges: list[list[_Range]], integer: bool) -> list:
    """One scan: rows, smallest and largest value per (column, range, bucket).

    All columns share one set of expressions; the bounds of the ranges are looked up by column.
    """
    width = max(len(r) for r in ranges)
    buckets = max(MIN_BUCKETS, min(BUCKETS, ROUND_COUNTERS // sum(len(r) for r in ranges)))
    kind = "bigint" if integer else "double"

    def bounds(pick, empty, kind: str = kind) -> Column:
        return F.array(*[
            F.array(*[F.lit(pick(r[k]) if k < len(r) else empty).cast(kind) for k in range(width)]) for r in ranges])

    def scaled(r: _Range, end):
        return end if integer else _py_log_scale(end) if r.log else end / 2

    cells = [x for slot, c in enumerate(columns) for x in (F.lit(slot), c)]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("slot", "value")).filter(F.col("value").isNotNull())
    slot, value = F.col("slot"), F.col("value")
    # an empty range has its bounds crossed
    lows, highs = bounds(lambda r: r.low, 1)[slot], bounds(lambda r: r.high, 0)[slot]
    which = F.lit(None).cast("int")
    for k in reversed(range(width)):
        which = F.when((value >= lows[k]) & (value <= highs[k]), F.lit(k)).otherwise(which)
    placed = long.withColumn("range", which).filter(F.col("range").isNotNull())
    at = F.col("range")
    start = bounds(lambda r: scaled(r, r.low), 0)[slot][at]
    span = bounds(lambda r: float(scaled(r, r.high) - scaled(r, r.low)), 1.0, "double")[slot][at]
    if integer:
        position = value
    else:
        # halves keep the difference of two huge ends finite
        log = bounds(lambda r: float(r.log), 0.0)[slot][at]
        position = F.when(log == 1.0, _log_scale(value)).otherwise(value / 2)
    share = (position - start).cast("double") / span
    bucket = F.least(F.greatest(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1))
    return (
        placed.withColumn("bucket", bucket.cast("int"))
        .groupBy("slot", "range", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()
    )


def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    spans: dict[str, tuple],
    ranks: dict[str, list[int]],
    integer: bool = False,
) -> dict[str, dict[int, float]]:
    """Values at the given ranks (0-based, nulls left out) of finite double or bigint columns.

    ``spans`` gives (non-null count, min, max) of each column.
    """
    found: dict[str, dict] = {n: {} for n in columns}
    open_ranges: dict[str, list[_Range]] = {}
    for name in columns:
        n, low, high = spans[name]
        whole = _Range(low, high, n, 0, tuple(sorted(set(ranks[name]))), not integer and high - low > 1e6)
        left = _settle(whole, found[name])
        if left:
            open_ranges[name] = [left]

    while open_ranges:
        names = list(open_ranges)
        counted: dict[tuple[int, int], list] = {}
        rows = _bucket_counts(df, [columns[n] for n in names], [open_ranges[n] for n in names], integer)
        for row in rows:
            counted.setdefault((row.slot, row.range), []).append(row)
        following: dict[str, list[_Range]] = {}
        for slot, name in enumerate(names):
            for k, r in enumerate(open_ranges[name]):
                position = r.below
                for row in sorted(counted[slot, k], key=lambda x: x.bucket):
                    inside = tuple(x for x in r.ranks if position <= x < position + row.n)
                    if inside:
                        if not r.log and (row.low, row.high) == (r.low, r.high):
                            raise ArithmeticError(f"rank search makes no progress on {name}")
                        left = _settle(_Range(row.low, row.high, row.n, position, inside, False), found[name])
                        if left:
                            following.setdefault(name, []).append(left)
                    position += row.n
        open_ranges = following
    return found


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    ranges: dict[str, tuple[int, float, float]],
    probabilities: list[float],
) -> dict[str, dict[float, float]]:
    """Linearly interpolated quantiles ``{name: {p: value}}``.

    ``columns`` are double expressions over ``df``; ``ranges`` gives (non-null count, min, max) of
    each, which the caller already has from its wide aggregate.
    """
    filled = {n: c for n, c in columns.items() if ranges[n][0]}
    clamped = {n: F.least(F.greatest(c, F.lit(-_MAX)), F.lit(_MAX)) for n, c in filled.items()}
    # least and greatest skip nulls, so an empty cell has to stay empty explicitly
    clamped = {n: F.when(filled[n].isNotNull(), c) for n, c in clamped.items()}
    spans = {n: (ranges[n][0], max(ranges[n][1], -_MAX), min(ranges[n][2], _MAX)) for n in filled}
    ranks = {n: _wanted_ranks(ranges[n][0], probabilities) for n in filled}
    found = order_statistics(df, clamped, spans, ranks)
    out: dict[str, dict[float, float]] = {}
    for name in filled:
        values = {r: (math.copysign(math.inf, v) if abs(v) >= _MAX else v) for r, v in found[name].items()}
        out[name] = {p: _interpolate(values, ranges[name][0], p) for p in probabilities}
    return out
