import numpy as np
import pandas as pd
import pytest

from limpid.operators.missingness import chi_square
from limpid.operators.profile import detect_missingness, histogram_edges, profile_table
from limpid.operators.score import count_issues, overall_score, score_breakdown, score_report
from limpid.operators.values import SlotSummary


def pad(values, n):
    return list(values) + [None] * (n - len(values))


def columns_of(profile):
    return {c.column: c for c in profile.columns}


def test_type_detection_boundaries(frame):
    cases = {
        "ints": ([1, 2, 3, 4, 5], "numeric", "int"), "floats": ([1.5, 2.0, 3.0, 4.0, 5.0], "numeric", "float"),
        "ints_gap": ([1, 2, None, 4, 5], "numeric", "float"), "bools": ([True, False, True, True, False], "bool", "bool"),
        "bools_gap": ([True, None, True, True, False], "bool", "object"),
        "num80": (["1", "2", "3", "4", "x"], "numeric", "object"), "num60": (["1", "2", "3", "x", "y"], "string", "object"),
        "date80": (["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "x"], "date", "object"),
        "date60": (["2024-01-01", "2024-01-02", "2024-01-03", "x", "y"], "string", "object"),
        "negative": (["-1", "-2.5", "3", "4", "5"], "numeric", "object"),
        "words": (["yes", "no", "Y", "ON", "0"], "bool", "object"), "t_f": (["t", "f", "t", "f", "t"], "string", "object"),
        "empty": ([None] * 5, "string", "object"), "city": (["a", "b", "c", "d", "e"], "string", "object"),
    }
    found = columns_of(profile_table(frame(**{n: v for n, (v, _, _) in cases.items()})))
    for name, (_, kind, storage) in cases.items():
        assert (found[name].detected_type, found[name].storage_type) == (kind, storage), name


def test_numeric_profile_is_numpys(frame):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(100, 10, 500), [400.0, -200.0, 1000.0]])
    p = profile_table(frame(x=[float(v) for v in values], const=[5.0] * 503)).columns
    q1, med, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    lower, upper = round(q1 - 1.5 * (q3 - q1), 4), round(q3 + 1.5 * (q3 - q1), 4)
    counts, edges = np.histogram(values, bins=10)
    x = p[0]
    assert x.stats["mean"] == round(values.mean(), 4) and x.stats["median"] == round(med, 4)
    assert x.stats["std"] == round(values.std(ddof=1), 4)
    assert (x.stats["q1"], x.stats["q3"]) == (round(q1, 4), round(q3, 4))
    assert x.outliers == {"count": int(((values < lower) | (values > upper)).sum()), "method": "IQR", "lower": lower, "upper": upper}
    assert x.stats["histogram"]["counts"] == counts.tolist()
    assert x.stats["histogram"]["edges"] == [round(e, 4) for e in edges]
    assert p[1].stats["std"] == 0.0 and p[1].stats["histogram"]["counts"] == [0, 0, 0, 0, 0, 503, 0, 0, 0, 0]


def test_histogram_edges_are_numpys():
    for low, high in ((0.1, 0.7), (-3.0, 11.5), (2.0, 2.0)):
        assert histogram_edges(low, high) == np.histogram_bin_edges([low, high], bins=10).tolist()


def test_row_thresholds(frame):
    n = 30
    data = {"n30": [float(i) for i in range(30)], "n29": pad([float(i) for i in range(29)], n),
            "n9": pad([float(i) for i in range(9)], n), "n10": pad([float(i) for i in range(10)], n),
            "single": pad([7.0], n)}
    found = columns_of(profile_table(frame(**data)))
    assert found["n30"].outliers["lower"] is not None and found["n29"].outliers["lower"] is None
    assert "histogram" in found["n10"].stats and "histogram" not in found["n9"].stats
    assert found["single"].stats == {"min": 7.0, "max": 7.0, "mean": 7.0, "median": 7.0, "std": 0.0}
    assert found["n9"].null_pct == 70.0


def test_numeric_sentinels(frame):
    base = [float(i) for i in range(1, 46)]
    n = 50
    found = columns_of(profile_table(frame(
        low=base + [-999.0] * 5, high=base + [9999.0] * 5, rare=pad(base + [-999.0] * 4, n), flat=[19.0] * 49 + [200.0],
        few=pad([1.0, 2.0, 3.0, 4.0] + [-999.0] * 5, n), text=[str(int(v)) for v in base] + ["-999"] * 5)))
    assert (found["low"].sentinel_count, found["low"].sentinel_values) == (5, [-999.0])
    assert found["high"].sentinel_values == [9999.0] and found["text"].sentinel_values == [-999.0]
    for name in ("rare", "flat", "few"):
        assert (found[name].sentinel_count, found[name].sentinel_values) == (0, []), name


def test_many_repeated_extremes_stay_whole(frame, monkeypatch):
    from limpid.operators import profile as module
    from limpid.operators.apply import apply_plan
    from limpid.plans.model import ColumnRule, Plan

    monkeypatch.setattr(module, "SENTINEL_LIST_LIMIT", 2)
    values = [float(i % 40) for i in range(400)] + [v for v in (1e6, 2e6, 3e6) for _ in range(5)]
    df = frame(x=values)
    c = module.profile_table(df).columns[0]
    assert c.sentinel_count == 15 and c.sentinel_values == [] and c.sentinel_table and c.has_sentinels
    out = apply_plan(df, Plan({"x": ColumnRule("float", sentinel_table=c.sentinel_table)})).df
    assert out.filter("x is null").count() == 15 and out.count() == 415


def test_sentinel_tables_reach_frames_and_queries(frame, spark, monkeypatch):
    from limpid.catalog import cleaning, profiling
    from limpid.functions.coerce import number_text
    from limpid.operators import profile as module
    from limpid.plans.rules import build_plan, plan_frame
    from pyspark.sql import functions as F

    numbers = [1.5, -9999999.0, 12345678.25, 1e15, 1e16, -2.5e20, 1e-4, 3.5e-5, 0.1, 123456.789, 1e300, float("inf"), -7.0, 0.0]
    rows = spark.createDataFrame([(v,) for v in numbers], "v double").select("v", number_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [str(r.v) for r in rows]
    folder = "/root/testdata/sf0.001"
    whole = {n: sorted(map(tuple, f(spark, folder).collect()), key=repr)
             for n, f in (("a", profiling.numeric_sentinels), ("b", cleaning.replace_sentinels))}
    df = frame(x=[float(i % 40) for i in range(400)] + [v for v in (1e6, 2e7, 3e6) for _ in range(5)])
    listed = profile_table(df).column_frame(spark).first().sentinel_values
    monkeypatch.setattr(module, "SENTINEL_LIST_LIMIT", 0)
    profile = profile_table(df)
    assert profile.columns[0].sentinel_table
    assert profile.column_frame(spark).first().sentinel_values == listed == ["1000000.0", "3000000.0", "20000000.0"]
    assert plan_frame(spark, build_plan(profile)).first().sentinel_values == listed
    for module_ in (profiling, cleaning):
        for f in vars(module_).values():
            getattr(f, "cache_clear", lambda: None)()
    assert {n: sorted(map(tuple, f(spark, folder).collect()), key=repr)
            for n, f in (("a", profiling.numeric_sentinels), ("b", cleaning.replace_sentinels))} == whole


def test_string_profile(frame):
    data = ["b"] * 3 + ["a"] * 3 + ["c", "d", "e", "f"] + [None] * 2
    c = profile_table(frame(x=data)).columns[0]
    assert c.unique_count == 6 and c.cardinality_pct == 60.0 and c.null_count == 2 and c.null_pct == 16.7
    # ties by first occurrence
    assert c.top_values == [("b", 3), ("a", 3), ("c", 1), ("d", 1), ("e", 1)]
    assert profile_table(frame(x=[True, False, True])).columns[0].top_values == [("True", 2), ("False", 1)]


def test_long_cells_are_counted_by_digest(frame, monkeypatch):
    from limpid.operators import values as V

    words = ["x" * 200, "y" * 200, "x" * 200, "https://a.b/" + "z" * 150, "https://a.b/" + "w" * 150, "short", None]
    days = ["2024-01-05" + " " * 140, "2024-01-06", "2024-01-07 " + " " * 140, "2024-01-08", "bad" + " " * 140, "2024-01-09", None]
    nums = ["1" + "0" * 140, "2", "3", "4", "5" + " " * 140, "6", None]
    df = frame(words=words, days=days, nums=nums)
    by_digest = profile_table(df)
    assert by_digest.columns[0].top_values[0] == ("x" * 200, 2) and by_digest.columns[0].unique_count == 5
    assert by_digest.columns[1].detected_type == "date" and by_digest.columns[1].invalid_count == 1
    assert by_digest.columns[2].invalid_count == 0
    monkeypatch.setattr(V, "LONG_CELL", 10_000)
    assert profile_table(df) == by_digest


def test_string_sentinels(frame):
    c = profile_table(frame(x=["ok", "N/A", " n/a ", "unknown", "-", "?", "", "NULL", "fine", "missing"])).columns[0]
    assert c.sentinel_count == 8
    assert c.sentinel_values == sorted(["N/A", "n/a", "unknown", "-", "?", "", "NULL", "missing"])


def test_patterns_and_consistency(frame):
    mails = ["a@b.co", "c@d.co", "e@f.co", "broken"]
    half = ["a@b.co", "c@d.co", "x", "y"]
    p = profile_table(frame(mails=mails, half=half, n=[1, 2, 3, 4]))
    found = columns_of(p)
    assert found["mails"].pattern == "email" and found["mails"].invalid_count == 1
    assert found["half"].pattern is None and found["half"].invalid_count == 0
    assert p.consistency == round((1 - 1 / 12) * 100, 2)


def test_validity_uses_a_plain_majority(frame):
    p = profile_table(frame(half=["1", "2", "x", "y", None], most=["1", "2", "3", "x", "y"]))
    assert p.invalid_cells == 2 and p.validity == round((10 - 1 - 2) / 10 * 100, 2)


def test_format_inconsistency_and_sample(frame):
    values = ["1", "2", "3", "4", "5", "x%", "y%", "z%", "w%", None]
    c = profile_table(frame(x=values)).columns[0]
    assert c.format_inconsistency and c.castable_pct == 55.6 and c.non_castable_sample == ["x%", "y%", "z%"]
    assert not profile_table(frame(x=["1", "2", "3", "4", "x", "y", "z"])).columns[0].format_inconsistency


def test_dates(frame, spark):
    c = profile_table(frame(x=["2024-03-01", "01/02/2024", "2023-12-31", "2024-01-05", "bad"])).columns[0]
    assert c.stats == {"min_date": "2023-12-31", "max_date": "2024-03-01"} and c.invalid_count == 1
    c = profile_table(spark.sql("select timestamp'2024-05-06 07:08:09' as t")).columns[0]
    assert (c.detected_type, c.stats) == ("date", {"min_date": "2024-05-06", "max_date": "2024-05-06"})


def test_date_column_with_numbers_has_numeric_statistics(frame):
    # "2024" parses as a number, so the statistics are those of the numbers
    c = profile_table(frame(x=["2024-03-01", "2024-03-02", "2024-03-03", "2024", "2024-03-05"])).columns[0]
    assert c.detected_type == "date" and c.stats["min"] == 2024.0 and "min_date" not in c.stats


def test_whole_table(frame):
    p = profile_table(frame(name=["ann", "bob", "cy", "ann", "eve"], age=[30, 40, 50, 30, 20], pay=[1.0, 2.0, None, 1.0, 5.0]), 3)
    assert (p.total_rows, p.total_columns, p.total_cells) == (5, 3, 15)
    assert (p.missing_cells, p.duplicate_rows, p.malformed_rows) == (1, 1, 3)
    assert p.completeness == pytest.approx(100 * 14 / 15) and p.uniqueness == 80.0
    assert overall_score(p) == 91.0    # gaps lower completeness and validity alike
    assert set(score_breakdown(p)) == {"overall", "completeness", "uniqueness", "validity", "consistency"}
    assert count_issues(p)["malformed_rows"] == 3 and score_report(p)["total_columns"] == 3


def test_empty_and_all_null(spark, frame):
    p = profile_table(spark.createDataFrame([], "a string, b bigint"))
    assert (p.total_rows, p.completeness, p.uniqueness, p.validity, p.consistency) == (0, 100.0, 100.0, 100.0, 100.0)
    p = profile_table(frame(a=[None, None], b=[None, None]))
    assert p.completeness == 0.0 and p.duplicate_rows == 1


def test_nan_counts_as_missing(spark):
    p = profile_table(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert p.missing_cells == 2 and p.columns[0].null_count == 2 and p.columns[0].stats["max"] == 1.0


def test_profile_does_not_depend_on_partitions(frame):
    df = frame(x=[str(i % 7) for i in range(200)], y=[float(i * i % 31) for i in range(200)], z=["k" + str(i % 3) for i in range(200)])
    assert profile_table(df.repartition(1)) == profile_table(df.repartition(8))


def test_names_with_dots_and_ticks(frame):
    p = profile_table(frame(**{"a.b": [1, 2], "c`d": ["x", "y"]}))
    assert [c.column for c in p.columns] == ["a.b", "c`d"] and p.columns[1].unique_count == 2


def test_missing_at_random(frame):
    kinds = ["ATM"] * 15 + ["POS"] * 15
    df = frame(txn_typ=kinds, merchant=[None if k == "ATM" else f"m{i % 3}" for i, k in enumerate(kinds)], amount=[100.0] * 30)
    found = detect_missingness(df)
    assert [(a.column, a.correlated_with, a.test) for a in found] == [("merchant", "txn_typ", "chi2")]
    assert found[0].p_value < 0.001


def test_missing_at_random_by_number(frame):
    df = frame(x=[None if i > 60 else 1.0 for i in range(100)], noise=[float(i * 7919 % 13) for i in range(100)], load=[float(i) for i in range(100)])
    hits = {a.column: a for a in detect_missingness(df)}
    assert hits["x"].correlated_with == "load" and hits["x"].test == "point_biserial"
    series = pd.Series([1.0 if i > 60 else 0.0 for i in range(100)])
    assert hits["x"].statistic == pytest.approx(series.corr(pd.Series(range(100), dtype=float)))


def test_chi_square_with_continuity_correction():
    # 2 x 2 table: 10 of 30 missing in one category, 25 of 40 in the other
    n1, m1, n2, m2 = 30, 10, 40, 25
    p = (m1 + m2) / (n1 + n2)
    expected = [(m1, n1 * p), (n1 - m1, n1 * (1 - p)), (m2, n2 * p), (n2 - m2, n2 * (1 - p))]
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in expected)
    s = SlotSummary(2, n1 + n2, [], n1, n2, missing={"f": m1 + m2}, missing_share={"f": m1 * m1 / n1 + m2 * m2 / n2})
    assert chi_square(s, "f")[0] == pytest.approx(want)


def test_too_few_gaps_or_rows_are_not_tested(frame):
    assert detect_missingness(frame(x=[None] * 4 + [1.0] * 26, k=["a"] * 4 + ["b"] * 26)) == []
    assert detect_missingness(frame(x=[None] * 5 + [1.0] * 4, k=["a"] * 5 + ["b"] * 4)) == []
