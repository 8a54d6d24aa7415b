"""Stored plans and rules as tables against the plan objects."""

import random

from pyspark.sql import functions as F

from limpid.operators.profile import profile_table
from limpid.plans.frames import carried_plans, effective_plans, plan_columns, planned_columns
from limpid.plans.model import ColumnRule, DuplicateRule, MissingRule, OutlierRule, Plan
from limpid.plans.rules import build_plan
from limpid.sources.ledger import carried_plan


def plans():
    generated = Plan({"a.b": ColumnRule("float", True, MissingRule("median", None, 3), "z_score", ["w"], sentinel_values=[-999.0, 7.0]),
                      "c": ColumnRule(normalize=False)}, DuplicateRule("drop", ["c"], "last"),
                     {"a.b": OutlierRule("remove", "iqr", -1.5, 2.5, 9)}, metadata={"dq_score": 91.5, "generated_at": "x"},
                     eda={"total_rows": 3, "columns": {"a.b": {"top_values": {"x": 2}}}})
    approved = Plan({"a.b": ColumnRule("int", True, MissingRule("fill", 0, 3), rename_to="d")})
    return generated, approved


def test_which_plan_counts(spark):
    generated, approved = plans()
    own = Plan({"z": ColumnRule("bool")}, eda={"total_rows": 8})
    rows = [("r1", generated.to_json(), None), ("r2", generated.to_json(), approved.to_json()), ("r3", generated.to_json(), own.to_json()),
            ("r4", None, None), ("r5", "{not json", None), ("r6", generated.to_json(), "nor this")]
    runs = spark.createDataFrame(rows, "run_id string, plan_generated string, plan_approved string")
    found = effective_plans(runs)
    assert {r.run_id: r.source for r in found.collect()} == {"r1": "generated", "r2": "approved", "r3": "approved", "r6": "generated"}
    sections = {r.run_id: r.n for r in found.select("run_id", F.try_variant_get("plan._eda", "$.total_rows", "int").alias("n")).collect()}
    assert sections == {"r1": 3, "r2": 3, "r3": 8, "r6": 3}
    columns = {(r.run_id, r.column): r for r in plan_columns(found).collect()}
    one, two = columns["r1", "a.b"], columns["r2", "a.b"]
    assert (one.type, one.strategy, one.normalize, one.outlier_strategy, one.outlier_count, one.lower) == ("float", "median", "z_score", "remove", 9, -1.5)
    assert (two.type, two.strategy, two.value, two.rename_to, two.outlier_strategy) == ("int", "fill", "0", "d", None)
    assert columns["r1", "c"].normalize is None and len(columns) == 6
    carried = {r.run_id: r.plan_generated for r in carried_plans(runs).collect()}
    assert set(carried) == {"r1", "r2", "r3", "r6"}
    for run_id, generated_text, approved_text in rows[:3]:
        assert Plan.from_json(carried[run_id]) == Plan.from_json(carried_plan(generated_text, approved_text))


def test_rules_as_expressions(spark, frame):
    rng = random.Random(3)
    for rows, step in ((60, 7), (400, 3)):
        df = frame(n=[None if i % step == 0 else 5.0 * i for i in range(rows)], big=[10 ** 6 + i * i for i in range(rows)],
                   spread=[1000.0 if i % 97 == 1 else rng.random() for i in range(rows)], half=[None if i % 2 else 0.5 for i in range(rows)],
                   word=[rng.choice(["a", "b", None, "N/A"]) for _ in range(rows)], many=[None if i % 9 == 0 else f"k{i}" for i in range(rows)],
                   day=[f"2024-01-{i % 28 + 1:02}" if i % 11 else "never" for i in range(rows)], flag=[rng.choice([True, False, None]) for _ in range(rows)],
                   mail=[f"a{i}@b.co" if i % 5 else None for i in range(rows)], const=[7.0] * rows, none=[None] * rows)
        profile = profile_table(df, missingness=True)
        plan = build_plan(profile)
        dependent = [a.column for a in profile.associations or []]
        rules = planned_columns(profile.column_frame(spark).withColumns({
            "total_rows": F.lit(profile.total_rows), "dependent": F.col("column").isin(dependent)}))
        for r in rules.collect():
            c, o = plan.columns[r.column], plan.outliers.get(r.column)
            m = c.missing_values
            assert (r.type, r.nullable, r.strategy, r.fill_count, r.normalize, r.outlier_strategy, r.outlier_count) == (
                c.type, c.nullable, m and m.strategy, m and m.null_count, c.normalize or None, o and o.strategy, o and o.count), r.column
