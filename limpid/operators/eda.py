"""Report datasets over a profile: missing ranking, shares, histograms, box plots, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limpid.functions.constants import TOP_VALUES

SCORE_KEYS = ("overall", "completeness", "uniqueness", "validity", "consistency")


def missing_ranking(columns: DataFrame) -> DataFrame:
    """Columns by share of missing cells, largest first, with a band."""
    pct = F.col("null_pct")
    band = (F.when(pct == 0, "none").when(pct < 10, "low").when(pct < 50, "medium").otherwise("high"))
    return columns.select("column", "ordinal", "null_pct", band.alias("band")).orderBy(F.desc("null_pct"), "ordinal")


def category_shares(columns: DataFrame) -> DataFrame:
    """Frequent values of categorical columns: share among the listed values, values not listed, nulls."""
    categorical = columns.filter(F.col("detected_type").isin("string", "bool") & (F.col("cardinality_pct") < 10))
    listed = categorical.select(
        "column", "unique_count", "null_count", F.posexplode("top_values").alias("rank", "top"))
    per_column = Window.partitionBy("column")
    total, largest = F.sum("count").over(per_column), F.max("count").over(per_column)
    return (
        listed.select("column", (F.col("rank") + 1).alias("rank"), F.col("top.value").alias("value"),
                      F.col("top.count").alias("count"), "unique_count", "null_count")
        .select("column", "rank", "value", "count",
                F.round(F.col("count") / total * 100, 1).alias("share_pct"),
                F.round(F.col("count") / largest * 100, 1).alias("bar_pct"),
                F.greatest(F.col("unique_count") - TOP_VALUES, F.lit(0)).alias("more_values"),
                "null_count",
                F.round(F.col("null_count") / (total + F.col("null_count")) * 100, 1).alias("null_bar_pct"))
    )


def histogram_bins(columns: DataFrame) -> DataFrame:
    """One row per histogram bin of every numeric column."""
    numeric = columns.filter((F.col("detected_type") == "numeric") & F.col("stats.histogram").isNotNull())
    bins = numeric.select("column", F.posexplode("stats.histogram.counts").alias("bin", "count"),
                          F.col("stats.histogram.edges").alias("edges"))
    return bins.select("column", "bin", F.col("edges")[F.col("bin")].alias("lower"),
                       F.col("edges")[F.col("bin") + 1].alias("upper"), "count")


def box_plots(columns: DataFrame) -> DataFrame:
    """Five-number summary per numeric column, with fence marks that lie inside the data range."""
    s, o = F.col("stats"), F.col("outliers")
    numeric = columns.filter((F.col("detected_type") == "numeric") & s["q1"].isNotNull() & s["q3"].isNotNull())
    marked = o["count"] > 0
    return numeric.select(
        "column", s["min"].alias("min"), s["q1"].alias("q1"), s["median"].alias("median"), s["q3"].alias("q3"),
        s["max"].alias("max"),
        F.when(marked & (o["lower"] > s["min"]), o["lower"]).alias("lower_mark"),
        F.when(marked & (o["upper"] < s["max"]), o["upper"]).alias("upper_mark"))


def score_by_dimension(scores: DataFrame) -> DataFrame:
    """The four dimensions as rows, rounded to whole numbers."""
    pairs = [x for k in SCORE_KEYS[1:] for x in (F.lit(k), F.floor(F.col(k) + 0.5).cast("int"))]
    return scores.select(F.stack(F.lit(len(SCORE_KEYS) - 1), *pairs).alias("dimension", "value"))


def summary_figures(table: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows, columns, duplicates and score of one table."""
    return table.join(scores.select("overall"), F.lit(True)).select(
        "total_rows", "total_columns", "duplicate_rows", F.col("overall").alias("dq_score"))


def compare_scores(before: DataFrame, after: DataFrame) -> DataFrame:
    """Score per dimension before and after, clamped for display, with a signed difference."""
    pairs = [x for k in SCORE_KEYS for x in (F.lit(k), F.col("a." + k), F.col("b." + k))]
    both = before.alias("a").join(after.alias("b"), F.lit(True)).select(
        F.stack(F.lit(len(SCORE_KEYS)), *pairs).alias("dimension", "before", "after"))
    delta = F.round(F.col("after") - F.col("before"), 1)

    def clamp(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))

    return both.select(
        "dimension", "before", "after", clamp(F.col("before")).alias("before_bar"),
        clamp(F.col("after")).alias("after_bar"),
        F.concat(F.when(delta >= 0, "+").otherwise(""), F.format_string("%.1f", delta)).alias("delta"))


def compare_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issue counts and table size before and after; an issue absent afterwards counts as zero.

    A size without a later value is unchanged.
    """
    left = before.select(F.explode("issues_found").alias("kind", "before"))
    right = after.select(F.explode("issues_found").alias("kind", "after"))
    issues = left.join(right, "kind", "left").select("kind", "before", F.coalesce("after", F.lit(0)).alias("after"))
    pairs = [x for k in ("total_rows", "total_columns")
             for x in (F.lit(k), F.col("a." + k).cast("long"), F.coalesce(F.col("b." + k), F.col("a." + k)).cast("long"))]
    sizes = before.alias("a").join(after.alias("b"), F.lit(True)).select(
        F.stack(F.lit(2), *pairs).alias("kind", "before", "after"))
    return issues.unionByName(sizes).withColumn("delta", F.col("after") - F.col("before"))


def eda_frames(spark: SparkSession, profile) -> dict[str, DataFrame]:
    """All column reports of one profile."""
    columns = profile.column_frame(spark)
    return {"missing": missing_ranking(columns), "categories": category_shares(columns),
            "histograms": histogram_bins(columns), "boxes": box_plots(columns)}
