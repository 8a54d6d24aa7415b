import pytest
from pyspark.sql import functions as F

from limpid.operators import steps
from limpid.operators.apply import apply_plan, change_report
from limpid.operators.duplicates import drop_duplicates
from limpid.operators.impact import (
    Strategies, drop_flags, drop_impact, flag_patterns, patterns_of_flags, strategies_of,
)
from limpid.operators.transforms import check_transform, trial_transform
from limpid.plans.model import ColumnRule, DuplicateRule, MissingRule, OutlierRule, Plan, PlanError
from limpid.run import analyse, clean


def column(df, name):
    return [r[name] for r in df.orderBy("__row_id").collect()]


def run(df, columns=None, **kw):
    return apply_plan(df, Plan({n: r for n, r in (columns or {}).items()}, **kw))


def fill(strategy, value=None, kind="string"):
    return ColumnRule(kind, missing_values=MissingRule(strategy, value))


def test_number_cast_and_guard(frame):
    n = [str(50000 + 1000 * (i % 2)) for i in range(20)] + ["N/A"]
    out = run(frame(pay=n), {"pay": ColumnRule("float")})
    assert column(out.df, "pay")[-1] is None and out.skipped_casts == []
    out = run(frame(pay=["1", "2", "N/A"]), {"pay": ColumnRule("float")})
    assert column(out.df, "pay") == ["1", "2", "N/A"] and out.skipped_casts == ["pay"]


def test_blocked_cast_is_still_imputed_by_a_median(frame):
    out = run(frame(pay=["1", "2", "6", "x"]), {"pay": fill("median", kind="float")})
    assert column(out.df, "pay") == [1.0, 2.0, 6.0, 2.0] and out.skipped_casts == ["pay"]


def test_int_cast_after_fill(frame):
    out = run(frame(x=[1.0, 2.0, None, 4.0]), {"x": fill("mean", kind="int")}).df
    assert out.schema["x"].dataType.simpleString() == "bigint" and column(out, "x") == [1, 2, 2, 4]
    out = run(frame(x=[1.0, None, 4.0]), {"x": fill("leave_null", kind="int")}).df
    assert out.schema["x"].dataType.simpleString() == "double"
    big = str(2 ** 62 + 1)
    assert column(run(frame(x=["1", big]), {"x": ColumnRule("int")}).df, "x") == [1, 2 ** 62 + 1]


def test_bool_and_date(frame):
    out = run(frame(b=["Yes", " no", "1", "what", None], d=["01/02/2024", "2024-03-04 05:06", "Jan 5, 2024", "bad", None]),
              {"b": ColumnRule("bool"), "d": ColumnRule("date")}).df
    assert column(out, "b") == [True, False, True, None, None]
    assert column(out, "d") == ["2024-01-02", "2024-03-04", "2024-01-05", None, None]
    assert column(run(frame(b=[1, 0, 2]), {"b": ColumnRule("bool")}).df, "b") == [True, False, None]


def test_fills(frame):
    df = frame(a=[1.0, None, 3.0, 10.0], m=["b", "a", None, "c"], k=[None, "x", "y", "x"], z=[None] * 4)
    out = run(df, {"a": fill("median", kind="float"), "m": fill("mode"), "k": fill("fill", "none"), "z": fill("mode")}).df
    assert column(out, "a") == [1.0, 3.0, 3.0, 10.0]
    assert column(out, "m") == ["b", "a", "a", "c"]         # smallest among ties
    assert column(out, "k") == ["none", "x", "y", "x"] and column(out, "z") == [None] * 4


def test_fill_literal_types(frame):
    df = frame(i=[1, None], f=[1.5, None], t=["a", None])
    out = run(df, {"i": fill("fill", 2.5, "float"), "f": fill("fill", "unknown"), "t": fill("fill", 7)}).df
    assert column(out, "i") == [1.0, 2.5] and column(out, "f") == ["1.5", "unknown"] and column(out, "t") == ["a", "7"]


def test_row_drops_come_after_all_fills(frame):
    df = frame(a=[1.0, None, 5.0, 9.0], b=["x", "y", None, "z"], c=[None, "q", "r", "s"])
    out = run(df, {"a": fill("mean", kind="float"), "b": fill("drop_row"), "c": fill("drop_row")}).df
    assert column(out, "a") == [5.0, 9.0]       # the mean saw the rows dropped later


def test_drop_column_and_leave_null(frame):
    out = run(frame(a=[1, None], b=["x", None]), {"a": fill("drop_column", kind="int"), "b": fill("leave_null"), "gone": fill("mode")})
    assert out.df.columns == ["__row_id", "b"] and column(out.df, "b") == ["x", None] and out.dropped_columns == ["a"]


def test_sentinels(frame):
    df = frame(x=[1.0, -999.0, 3.0], s=["active", " N/A ", "unknown"], t=["1", "-999", "3"])
    rules = {"x": ColumnRule("float", sentinel_values=[-999.0]), "s": ColumnRule(sentinel_values=["N/A", "unknown"]),
             "t": ColumnRule("float", sentinel_values=[-999.0])}
    out = run(df, rules).df
    assert column(out, "x") == [1.0, None, 3.0] and column(out, "s") == ["active", None, None]
    assert column(out, "t") == [1.0, -999.0, 3.0]       # a number does not match a text cell
    assert column(apply_plan(df, Plan(rules), coerce_sentinels=True).df, "t") == [1.0, None, 3.0]
    rules["s"].replace_sentinels = False
    assert column(run(df, rules).df, "s") == ["active", "N/A", "unknown"]


def test_sentinel_then_fill(frame):
    df = frame(s=["a", "a", "N/A", "b", None])
    out = run(df, {"s": ColumnRule(sentinel_values=["N/A"], missing_values=MissingRule("mode"))}).df
    assert column(out, "s") == ["a", "a", "a", "b", "a"]


@pytest.mark.parametrize("strategy, want", [
    ("winsorise", [10.0, 20.0, None, 50.0]), ("cap", [10.0, 20.0, None, 50.0]), ("remove", [10.0, 20.0, None]),
    ("keep", [10.0, 20.0, None, 9999.0])])
def test_outliers(frame, strategy, want):
    out = run(frame(x=[10.0, 20.0, None, 9999.0]), outliers={"x": OutlierRule(strategy, lower=5.0, upper=50.0)}).df
    assert column(out, "x") == want


def test_duplicates(frame):
    df = frame(a=[1, 1, 2, None, None], b=["x", "x", "y", None, None])
    assert column(run(df, duplicates=DuplicateRule("drop")).df, "__row_id") == [0, 2, 3]
    assert column(run(df, duplicates=DuplicateRule("drop", keep="last")).df, "__row_id") == [1, 2, 4]
    assert run(df, duplicates=DuplicateRule("ignore")).df.count() == 5
    df = frame(a=[1, 1, 2, 1], b=["x", "y", "z", "w"])
    assert column(drop_duplicates(df, ["a"], "first"), "b") == ["x", "z"]
    assert column(drop_duplicates(df, ["a"], "last"), "b") == ["z", "w"]
    with pytest.raises(ValueError):
        drop_duplicates(df.drop("__row_id"), ["a"])


def test_scaling(frame):
    df = frame(a=[0.0, 5.0, 10.0, 10.0], z=[1.0, 2.0, 3.0, 3.0], k=[7.0] * 4)
    kinds = {"a": ColumnRule("float", normalize="min_max"), "z": ColumnRule("float", normalize="z_score"),
             "k": ColumnRule("float", normalize="z_score")}
    out = run(df, kinds, duplicates=DuplicateRule("drop")).df
    assert column(out, "a") == [0.0, 0.5, 1.0] and column(out, "k") == [7.0] * 3
    assert column(out, "z") == pytest.approx([-1.224744871391589, 0.0, 1.224744871391589])
    assert run(frame(s=["a", "b"]), {"s": ColumnRule(normalize="min_max")}).unscaled == ["s"]


def test_rename(frame):
    out = run(frame(a=[1], b=[2]), {"a": ColumnRule("int", rename_to="c")}).df
    assert out.columns == ["__row_id", "c", "b"]
    with pytest.raises((ValueError, PlanError)):
        run(frame(a=[1], b=[2]), {"a": ColumnRule("int", rename_to="b")})


def test_transforms(frame):
    df = frame(pct=["10%", "20%", None], n=[str(i) for i in range(3)], same=["a", "b", "c"])
    out = run(df, {"pct": ColumnRule("float", transform_code="try_cast(rtrim('%', col) as double) / 100"),
                   "n": ColumnRule(transform_code="nullif(col, col)"), "same": ColumnRule(transform_hint="upper case")})
    assert column(out.df, "pct") == [0.1, 0.2, None]
    assert column(out.df, "n") == ["0", "1", "2"] and "loses 100.00%" in out.reverted_transforms["n"]
    assert out.skipped_hints == ["same"]


def test_failing_transform_is_reverted_alone(frame):
    df = frame(a=["1", "x"], b=["q", "r"])
    out = run(df, {"a": ColumnRule(transform_code="cast(col as int)"), "b": ColumnRule(transform_code="upper(col)")})
    assert column(out.df, "a") == ["1", "x"] and column(out.df, "b") == ["Q", "R"] and set(out.reverted_transforms) == {"a"}


@pytest.mark.parametrize("code", [
    "", "upper(other)", "(select 1)", "sum(col)", "rand()", "java_method('a','b')", "col; drop table x", "upper(col", "row_number() over ()",
    "explode(array(col))"])
def test_unsafe_transforms(spark, code):
    assert check_transform(spark, code)[0] is False


@pytest.mark.parametrize("code", [
    "`reflect`('java.lang.System','getProperty',col)", "`java_method`('java.lang.System', 'getProperty', 'java.version')",
    "try_reflect('java.lang.System', 'getProperty', col)", "`rand`()", "`uuid`()", "current_timestamp", "current_date()", "current_user",
    "`sum`(length(col))", "max(col) over ()", "count(distinct col)", "upper(col) filter (where true)", "identifier('reflect')('a', 'b', col)",
    "system.builtin.rand()", "exists(select 1)", "col in (select 'a')", "transform(array(col), x -> x)", "timestamp 'now'", "date 'today'",
    "concat(col, :p)", "*", "t.col", "col[0]", "struct(col).col", "java_method /* x */ ('a', 'b')", 5, None])
def test_refused_by_the_tree(spark, code):
    ok, reason = check_transform(spark, code)
    assert not ok and reason


@pytest.mark.parametrize("code", [
    "Upper(COL) || 'x'", "`upper`(`col`)", "case when col like '%rand()%' then 'select' else substring(col from 1 for 2) end",
    "if(col between 'a' and 'b', -length(col), col :: int)", "col is not null and col rlike 'sum\\\\('", "trim(both '`' from col)",
    "to_date(split_part(col, ' ', 1), 'yyyy-MM-dd')", "coalesce(nvl2(col, 'a', 'b'), to_number(col, '99'))", "position('a' in col) % 2"])
def test_allowed_by_the_tree(spark, code):
    assert check_transform(spark, code) == (True, "")


def test_a_registered_function_does_not_pass_under_an_allowed_name(spark):
    own = spark.newSession()
    own.udf.register("initcap", lambda s: s)
    assert check_transform(own, "initcap(col)")[0] is False
    assert check_transform(spark, "initcap(col)")[0] is True


def test_trials(frame):
    df = frame(x=["1%", "2%", None], y=["a", "b", "c"])
    assert trial_transform(df, "x", "replace(col, '%', '')") == (True, "")
    assert "empty cell" in trial_transform(df, "x", "coalesce(col, 'None')")[1]
    assert "loses" in trial_transform(df, "y", "try_cast(col as int)")[1]
    assert check_transform(df.sparkSession, "'select ' || col")[0]


def test_winsorised_integer_column_becomes_double(frame):
    out = run(frame(x=[1, 2, 100]), {"x": ColumnRule("int")}, outliers={"x": OutlierRule("cap", lower=0.0, upper=50.5)}).df
    assert column(out, "x") == [1.0, 2.0, 50.5]


# --- drop impact ---

@pytest.fixture()
def messy(frame):
    a = [None, 1.0, 2.0, 500.0, 3.0, 3.0, None, 4.0]
    s = ["k", "unknown", "k", "k", "k", "k", "k", " unknown "]
    return frame(a=a, s=s)


PLAN = Plan({"a": ColumnRule("float", missing_values=MissingRule("drop_row")),
             "s": ColumnRule(missing_values=MissingRule("mode"), sentinel_values=["unknown"])},
            DuplicateRule("drop"), {"a": OutlierRule("remove", lower=0.0, upper=10.0)})


def test_impact(messy):
    row = drop_impact(flag_patterns(messy, PLAN), strategies_of(PLAN)).first().asDict()
    # rows 0 and 6 are equal and both null; 5 repeats 4; 3 is an outlier
    assert row == {"rows_before": 8, "rows_dropped": 4, "rows_after": 4, "null_drops": 2, "outlier_drops": 1,
                   "duplicate_drops": 2, "overlap_saved": 1}
    none = drop_impact(flag_patterns(messy, PLAN), Strategies({"a": "mean"}, {"a": "keep"}, "ignore")).first()
    assert (none.rows_dropped, none.rows_after, none.overlap_saved) == (0, 8, 0)


def test_flags_and_patterns_agree(messy):
    flags = drop_flags(messy, PLAN)
    rows = {r["__row_id"]: (r.null_a, r.null_s, r.outlier_a, r.duplicate) for r in flags.collect()}
    assert rows[0] == (True, False, False, False) and rows[6] == (True, False, False, True)
    assert rows[1] == (False, True, False, False) and rows[7] == (False, False, False, False)   # padded text is not matched
    assert rows[3] == (False, False, True, False) and rows[5] == (False, False, False, True)
    chosen = strategies_of(PLAN)
    assert drop_impact(patterns_of_flags(flags), chosen).collect() == drop_impact(flag_patterns(messy, PLAN), chosen).collect()


def test_duplicates_are_found_by_key_alone(messy):
    """Counts and flags shuffle keys and booleans, never the cells."""
    from limpid.operators import duplicates as D

    assert D.count_duplicates(messy) == 2
    assert column(drop_duplicates(messy), "__row_id") == [0, 1, 2, 3, 4, 7]
    assert column(drop_duplicates(messy, keep="last"), "__row_id") == [1, 2, 3, 5, 6, 7]
    for frame_ in (drop_flags(messy, PLAN), flag_patterns(messy, PLAN)):
        text = frame_._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanges and not any("(a#" in line or "(s#" in line for line in exchanges)


def test_keys_tell_nulls_and_zeros(spark):
    from limpid.operators import duplicates as D

    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,), (None,)], "x double")
    assert D.count_duplicates(df) == 3
    moved = spark.createDataFrame([(None, "x"), ("x", None), (None, None), ("x", "x")], "a string, b string")
    assert D.count_duplicates(moved) == 0


def test_long_sentinel_sets_work_like_lists(spark, frame, tmp_path):
    df = frame(a=[None, -9.0, 1.0, -9.0, 7.0, None], s=["-9", "1", "-9", "7", None, "x"])
    path = str(tmp_path / "codes")
    spark.createDataFrame([(-9.0,), (7.0,)], "value double").write.parquet(path)

    def plan(listed):
        source = {"sentinel_values": [-9.0, 7.0]} if listed else {"sentinel_table": path}
        return Plan({"a": ColumnRule("float", missing_values=MissingRule("drop_row"), **source),
                     "s": ColumnRule("string", missing_values=MissingRule("drop_row"), **source)})

    both = [plan(True), plan(False)]
    impacts = [drop_impact(flag_patterns(df, p), strategies_of(p)).collect() for p in both]
    assert impacts[0] == impacts[1] and impacts[0][0].null_drops == 6
    flags = [sorted(map(tuple, drop_flags(df, p).collect())) for p in both]
    assert flags[0] == flags[1]
    for coerce in (False, True):
        cells = [sorted(map(tuple, apply_plan(df, p, coerce_sentinels=coerce).df.collect())) for p in both]
        assert cells[0] == cells[1]


def test_impact_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, s string")
    row = drop_impact(flag_patterns(df, PLAN), strategies_of(PLAN)).first()
    assert (row.rows_before, row.rows_dropped, row.overlap_saved) == (0, 0, 0)


# --- whole run ---

def test_analyse_and_clean(frame, spark, tmp_path):
    n = 120
    df = frame(key=list(range(n)), amount=[None if i % 10 == 0 else float(i % 17) for i in range(n)],
               seg=["unknown" if i % 20 == 0 else "ab"[i % 2] for i in range(n)])
    found = analyse(df)
    assert 0 <= found.scores["overall"] <= 100 and set(found.plan.columns) == {"key", "amount", "seg"}
    found.plan.columns["amount"].missing_values = MissingRule("mean")
    done = clean(df, found.plan, str(tmp_path), "f", "r")
    assert done.scores["completeness"] == 100.0 and done.scores["issues_found"]["sentinel_values"] == 0
    assert done.scores["overall"] >= found.scores["overall"]
    assert spark.read.option("header", True).csv(done.path).count() == done.scores["total_rows"]
    report = change_report(df, done.applied.df).first()
    assert report.rows_before == n and report.rows_after == done.scores["total_rows"]
    again = apply_plan(done.applied.df, Plan({n: r for n, r in found.plan.columns.items() if not r.normalize})).df
    assert again.exceptAll(done.applied.df).count() == 0        # a clean table stays as it is


def test_steps_are_narrow(frame):
    df = steps.winsorise(steps.strip_text(frame(a=[1.0], b=["x"])), {"a": (0.0, 1.0)})
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
