"""Sketches against exact ranks and counts; counts observed on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limpid.operators import sketches as S
from limpid.operators.apply import observed, observed_rows
from limpid.operators.profile import profile_table
from limpid.plans.model import ColumnRule, MissingRule, Plan
from limpid.operators.apply import apply_plan
from limpid.run import clean


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(0, 60_000, 1, 6).select(
        F.col("id"), F.exp(F.rand(3) * 12).alias("skewed"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.randn(4)).alias("hot"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 997).cast("string")).alias("text"), F.lit(None).cast("double").alias("none")).cache()


def test_rank_error_of_merged_parts(spark, numbers):
    parts = S.column_sketches(numbers, F.expr("id % 6"), row_id=None).cache()
    assert parts.select("part").distinct().count() == 6
    merged = S.merged_sketches(parts).cache()
    assert {r.column: (r.filled, r.numbers) for r in merged.collect()} == {
        "id": (60_000, 60_000), "skewed": (60_000, 60_000), "hot": (60_000, 60_000), "text": (48_000, 48_000)}
    data = numbers.toPandas()
    for r in S.sketched_quantiles(merged, [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]).collect():
        cells = data[r.column].dropna().astype(float)
        low, high = (cells < r.value).mean(), (cells <= r.value).mean()
        assert low - S.rank_error() <= r.p <= high + S.rank_error(), r
    for r in S.sketched_distinct(merged).collect():
        true = data[r.column].nunique()
        assert abs(r.estimate - true) <= S.distinct_error() * true
    assert S.column_sketches(numbers.where("false"), row_id=None).count() == 0


def test_profile_and_median_by_sketches(spark, numbers):
    exact, approx = (profile_table(numbers.drop("text"), row_id=None, approx=a) for a in (False, True))
    for name in ("skewed", "hot"):
        a, b = exact.column(name).stats, approx.column(name).stats
        assert (a["min"], a["max"], a["mean"], a["std"]) == (b["min"], b["max"], b["mean"], b["std"])
        cells = np.sort(numbers.select(name).toPandas()[name].to_numpy())
        for key, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            low, high = np.searchsorted(cells, b[key] - 1e-4), np.searchsorted(cells, b[key] + 1e-4)
            assert low / len(cells) - S.rank_error() <= p <= high / len(cells) + S.rank_error()
    gaps = numbers.select(F.when(F.col("id") % 4 > 0, F.col("skewed")).alias("x"))
    filled = apply_plan(gaps, Plan({"x": ColumnRule("float", missing_values=MissingRule("median"))}), None, approx=True).df
    value = filled.groupBy("x").count().orderBy(F.desc("count")).first().x
    cells = np.sort(gaps.dropna().toPandas()["x"].to_numpy())
    assert abs(np.searchsorted(cells, value) / len(cells) - 0.5) <= S.rank_error()


def test_changes_without_a_job(spark, frame):
    df = frame(a=[1, None, 3, 3, None] * 20, b=["x", "y", "z", "z", "w"] * 20)
    plan = Plan({"a": ColumnRule("float", missing_values=MissingRule("drop_row")), "b": ColumnRule(rename_to="c")})
    done = clean(df, plan)
    spark.sparkContext.setJobGroup("changes", "changes")
    rows = done.changes.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in rows] == [(100, 60, 40, ["b"])]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("changes")) <= 1
    empty, seen = observed(df.where("false"))
    empty.write.format("noop").mode("overwrite").save()
    assert observed_rows(seen, df.where("false")) == 0
    assert clean(df.where("false"), plan).changes.first().rows_before == 0
