"""Bitmaps of drop flags against counting the flags themselves."""

import itertools
import random

import pytest

from limpid.operators import masks
from limpid.operators.impact import Strategies, drop_impact, patterns_of_flags
from limpid.sources.tables import ROW_ID


def flags_frame(spark, rows=70_000, step=1):
    rng = random.Random(4)
    data = [(i * step, rng.random() < 0.2, rng.random() < 0.01, None if i % 5 else True, i == 40_000) for i in range(rows)]
    return spark.createDataFrame(data, f"{ROW_ID} long, null_a boolean, `null_b.c` boolean, outlier_a boolean, duplicate boolean")


@pytest.mark.parametrize("step, dense", [(1, True), (1_000_003, False)])
def test_every_choice(spark, step, dense):
    flags = flags_frame(spark, step=step).cache()
    found = masks.flag_masks(flags, dense=dense).cache()
    assert found.where("operation = 'rows'").count() == 3
    patterns = patterns_of_flags(flags.fillna(False)).cache()
    options = itertools.product(("drop_row", "median"), ("drop_row", "mode"), ("remove", "keep"), ("drop", "ignore"))
    choices = {str(k): Strategies({"a": a, "b.c": b, "gone": "drop_row"}, {"a": o}, d) for k, (a, b, o, d) in enumerate(options)}
    got = {r.choice: tuple(r)[1:] for r in masks.impacts_of_masks(found, choices).collect()}
    assert got == {name: tuple(drop_impact(patterns, chosen).first()) for name, chosen in choices.items()}
    assert tuple(masks.impact_of_masks(found, choices["0"]).first()) == got["0"]


def test_overlaps(spark):
    flags = flags_frame(spark, 5000)
    got = {(r.operation, r.other): r.rows for r in masks.overlaps_of_masks(masks.flag_masks(flags)).collect()}
    rows = flags.fillna(False).collect()
    names = ["duplicate", "null_a", "null_b.c", "outlier_a"]
    want = {(a, b): sum(r[a] and r[b] for r in rows) for a, b in itertools.combinations(names, 2)}
    assert got == {k: n for k, n in want.items() if n}


def test_empty(spark):
    found = masks.flag_masks(flags_frame(spark, 10).where("false"))
    assert found.count() == 0
    row = masks.impact_of_masks(found, Strategies({"a": "drop_row"}, {}, "drop")).first()
    assert row.rows_before == row.rows_dropped == row.overlap_saved == 0
