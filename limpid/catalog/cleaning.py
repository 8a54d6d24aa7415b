"""Queries on plans and cleaning: rules, every step, the whole application, drop impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.catalog.profiling import (
    _CASTABLE, _DETECTED, _DOMINANT, _MATCHED, _OVERALL, COLUMNS, NATIVE, _numeric_sql, _repeats_sql,
    mar_sql, profile_of, score_sql, text_facts,
)
from limpid.catalog.views import sql_date, sql_number, sql_round, sql_sentinel, sql_union, table, view, with_views
from limpid.functions.coerce import col
from limpid.operators import eda, steps
from limpid.operators.apply import apply_plan, change_report
from limpid.operators.duplicates import drop_duplicates
from limpid.operators.impact import Strategies, drop_flags, drop_impact, flag_patterns, patterns_of_flags, strategies_of
from limpid.operators.masks import flag_masks, impacts_of_masks, overlaps_of_masks
from limpid.operators.profile import profile_table
from limpid.operators.sampling import column_samples, sample_rows
from limpid.operators.score import score_frame, score_report
from limpid.operators.transforms import trial_transform
from limpid.plans.compare import compare_plans, impact_labels, total_changes
from limpid.plans.edit import apply_renames, merge_edit, patch_column, patch_duplicates, set_outlier_strategy
from limpid.plans.frames import effective_plans, plan_columns, planned_columns
from limpid.plans.model import ColumnRule, MissingRule, Plan
from limpid.plans.rules import build_plan, plan_frame
from limpid.run import clean
from limpid.session import stage
from limpid.sources.tables import preview

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def plan_of(spark: SparkSession, folder: str, name: str) -> Plan:
    return build_plan(profile_of(spark, folder, name, missingness=True))


# --- the plan ---------------------------------------------------------------------------------

def _numbers(v: str) -> list[tuple[str, str, str]]:
    """(column, storage, SQL expression) of the numeric columns of a view."""
    out = [(c, s, c) for c, s in zip(NATIVE[v], ("int", "int", "float"))]
    return out + ([("acct_text", "object", sql_number("acct_text"))] if v == "d_customer" else [])


def _number_facts(v: str) -> str:
    parts = []
    for c, storage, x in _numbers(v):
        source = f"(SELECT {x} AS {c} FROM {v})"
        parts.append(
            f"SELECT s.*, '{storage}' AS storage, r.sentinel_count, "
            f"(SELECT count(*) - count({c}) FROM {v}) AS nulls, (SELECT count({c}) - count({x}) FROM {v}) AS invalid, "
            f"(SELECT count(*) FROM {v}) AS n "
            f"FROM ({_numeric_sql(source, c)}) s, ({_repeats_sql(source, c)}) r")
    return sql_union(parts)


def _plan_sql(v: str) -> str:
    needs = "(nulls > 0 OR invalid > 0 OR sentinel_count > 0)"
    pct = sql_round("nulls / n * 100", 1)
    text_nulls, text_invalid = "(total - filled)", (
        f"(CASE WHEN {_DETECTED} = 'date' THEN filled - dates WHEN {_DETECTED} = 'string' THEN filled - {_MATCHED} ELSE 0 END)")
    text_words = f"(CASE WHEN {_DETECTED} = 'date' THEN 0 ELSE sentinels END)"
    text_needs = f"({text_nulls} > 0 OR {text_invalid} > 0 OR {text_words} > 0)"
    dates = [] if v == "d_customer" else [
        "SELECT 'o_orderdate', 'date', false, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), "
        "CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM (SELECT 1)"]
    kept = f"""CASE WHEN {{0}} IN (SELECT "column" FROM mar) THEN 'leave_null'"""
    return f"""WITH facts AS ({text_facts(v)}), nums AS ({_number_facts(v)}), mar AS ({mar_sql(v)})
SELECT "column", CASE WHEN storage = 'float' OR min <> floor(min) OR max <> floor(max) THEN 'float' ELSE 'int' END AS type,
  {needs} AS nullable,
  CASE WHEN {needs} THEN {kept.format('"column"')} WHEN {pct} >= 50 THEN 'drop_column' WHEN outlier_count > 0
    OR abs(mean - median) / CASE WHEN std = 0 THEN 1 ELSE std END > 0.15 THEN 'median' ELSE 'mean' END END AS strategy,
  CAST(CASE WHEN {needs} THEN nulls + invalid + sentinel_count END AS BIGINT) AS null_count,
  CASE WHEN max > min AND greatest(abs(min), abs(max)) > 100 THEN
    CASE WHEN outlier_count > 0 THEN 'z_score' ELSE 'min_max' END END AS normalize,
  CASE WHEN outlier_count > 0 THEN CASE WHEN n < 100 THEN 'winsorise' WHEN outlier_count / n < 0.01 THEN 'remove'
    WHEN outlier_count / n <= 0.05 THEN 'winsorise' ELSE 'keep' END END AS outlier_strategy,
  CASE WHEN outlier_count > 0 THEN outlier_count END AS outlier_count FROM nums
UNION ALL
SELECT col, CASE WHEN {_DETECTED} IN ('bool', 'date') THEN {_DETECTED} WHEN {_DOMINANT} = 'date_iso' THEN 'date' ELSE 'string' END,
  {text_needs}, CASE WHEN {text_needs} THEN {kept.format('col')} WHEN {sql_round(f'{text_nulls} / total * 100', 1)} >= 50 THEN 'drop_column'
    WHEN {_DETECTED} = 'bool' THEN 'mode' WHEN {_DETECTED} = 'date' OR {_DOMINANT} IS NOT NULL THEN 'drop_row'
    WHEN {sql_round('uniq / filled * 100', 1)} < 10 THEN 'mode' ELSE 'drop_row' END END,
  CAST(CASE WHEN {text_needs} THEN {text_nulls} + {text_invalid} + {text_words} END AS BIGINT), NULL, NULL, NULL
FROM facts WHERE {_DETECTED} <> 'numeric'
{''.join(' UNION ALL ' + d for d in dates)}"""


def _plan_rows(spark, folder, v):
    return plan_frame(spark, plan_of(spark, folder, v)).select(
        "column", "type", "nullable", "strategy", "null_count", "normalize", "outlier_strategy", "outlier_count")


@query("plan_rules", with_views("d_orders", _plan_sql("d_orders")))
def plan_rules(spark, folder):
    return _plan_rows(spark, folder, "d_orders")


@query("plan_rules_customer", with_views("d_customer", _plan_sql("d_customer")))
def plan_rules_customer(spark, folder):
    return _plan_rows(spark, folder, "d_customer")


def profile_rows(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """Column frames of several profiles, with the name and the rows of their table."""
    parts = []
    for name in names:
        profile = profile_of(spark, folder, name, missingness=True)
        dependent = [a.column for a in profile.associations or []]
        parts.append(profile.column_frame(spark).withColumns({
            "table": F.lit(name), "total_rows": F.lit(profile.total_rows), "dependent": F.col("column").isin(dependent)}))
    return reduce(DataFrame.unionByName, parts)


@query("plan_rules_frame", with_views("d_orders d_customer", sql_union([f"SELECT '{v}' AS \"table\", * FROM ({_plan_sql(v)})" for v in ("d_orders", "d_customer")])))
def plan_rules_frame(spark, folder):
    """The rules as expressions over the profiles of both tables."""
    planned = planned_columns(profile_rows(spark, folder, ("d_orders", "d_customer")))
    return planned.select("table", "column", "type", "nullable", "strategy", F.col("fill_count").alias("null_count"),
                          "normalize", "outlier_strategy", "outlier_count")


_BOTH_PLANS = f"""WITH plans AS (SELECT 'generated' AS source, * FROM ({_plan_sql('d_orders')}) UNION ALL
  SELECT 'approved', * FROM ({_plan_sql('d_customer')})),
uses AS (SELECT CASE WHEN run_id % 3 = 0 THEN 'approved' ELSE 'generated' END AS source, count(*) AS runs FROM runs WHERE run_id % 5 <> 4 GROUP BY 1)"""


@query("ledger_plan_rules", with_views("d_orders d_customer runs", f"""{_BOTH_PLANS}
SELECT source, type, coalesce(strategy, 'none') AS strategy, CAST(sum(runs) AS BIGINT) AS columns, CAST(sum(runs * coalesce(outlier_count, 0)) AS BIGINT) AS outliers
FROM plans JOIN uses USING (source) GROUP BY ALL"""))
def ledger_plan_rules(spark, folder):
    """Rules over the stored plans of all runs: approved ones, or else generated ones; some runs have none."""
    columns = plan_columns(effective_plans(_runs_with_plans(spark, folder)))
    return columns.groupBy("source", "type", F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(
        F.count("column").alias("columns"), F.sum(F.coalesce("outlier_count", F.lit(0))).alias("outliers"))


@query("ledger_report_sections", with_views("d_orders runs", """SELECT CASE WHEN run_id % 3 = 0 THEN 'approved' ELSE 'generated' END AS source, count(*) AS runs,
  count(*) AS with_report, (SELECT count(*) FROM d_orders) AS total_rows FROM runs WHERE run_id % 5 <> 4 GROUP BY 1"""))
def ledger_report_sections(spark, folder):
    """The report section of a run's plan; an approved plan without one has that of the generated plan."""
    plans = effective_plans(_runs_with_plans(spark, folder))
    rows = F.try_variant_get("plan._eda", "$.total_rows", "bigint")
    return plans.groupBy("source").agg(F.count("run_id").alias("runs"), F.count(rows).alias("with_report"), F.max(rows).alias("total_rows"))


def _runs_with_plans(spark, folder) -> DataFrame:
    """The runs with plan texts: every third is approved with another plan and without a report section, every fifth has none."""
    generated, approved = (plan_of(spark, folder, v) for v in ("d_orders", "d_customer"))
    approved.eda = None
    return view(spark, folder, "runs").select(
        "run_id", F.when(F.col("run_id") % 5 != 4, F.lit(generated.to_json())).alias("plan_generated"),
        F.when((F.col("run_id") % 3 == 0) & (F.col("run_id") % 5 != 4), F.lit(approved.to_json())).alias("plan_approved"))


_MIXED_SAMPLE = ("(SELECT string_agg('''' || v || '''', ', ' ORDER BY row_no) FROM (SELECT acct_mixed AS v, row_no FROM d_customer "
                 f"WHERE acct_mixed IS NOT NULL AND {sql_number('acct_mixed')} IS NULL ORDER BY row_no LIMIT 3))")


@query("plan_warnings", with_views("d_customer", f"""WITH facts AS ({text_facts('d_customer')}),
mar AS ({mar_sql('d_customer')}),
t AS (SELECT *, filled - {_MATCHED} AS misfits, {_DETECTED} AS kind, {_CASTABLE} AS castable FROM facts)
SELECT col AS "column", 'drop_row will remove up to ' || (total - filled + misfits) || ' rows (' ||
  format('{{:.1f}}', (total - filled + misfits) / total * 100) || '% of dataset) where ''' || col || ''' is null or invalid.' AS warning
FROM t WHERE kind = 'string' AND (total > filled OR misfits > 0 OR sentinels > 0) AND col NOT IN (SELECT "column" FROM mar)
  AND ({_DOMINANT} IS NOT NULL OR {sql_round('uniq / filled * 100', 1)} >= 10)
UNION ALL SELECT col, '''' || col || ''' contains ' || sentinels || ' sentinel-like value(s) — will be replaced with null before imputation.'
FROM t WHERE kind IN ('string', 'bool') AND sentinels > 0
UNION ALL SELECT col, '''' || col || ''' has mixed value formats — ' || format('{{:.1f}}', 100 - castable) ||
  '% of values are not numeric-castable (e.g. ' || {_MIXED_SAMPLE} ||
  '). Type cast would corrupt data; a custom transform is needed to normalize format first.'
FROM t WHERE col = 'acct_mixed' AND kind = 'string' AND numbers >= 5 AND castable < 80"""))
def plan_warnings(spark, folder):
    return plan_frame(spark, plan_of(spark, folder, "d_customer")).select(
        "column", F.explode("warnings").alias("warning"))


_NULL_PCT = "format('{{:.1f}}', (count(*) - count({c})) / count(*) * 100)"


@query("plan_warnings_part", with_views("d_part", f"""WITH o AS ({_numeric_sql('d_part', 'price')}), n AS (SELECT count(*) AS n FROM d_part)
SELECT 'p_brand' AS "column", 'drop_column will remove the entire ''p_brand'' column (' || {_NULL_PCT.format(c='p_brand')} || '% of values are missing).' AS warning FROM d_part
UNION ALL SELECT 'p_type', '''p_type'' has ' || {_NULL_PCT.format(c='p_type')} || '% nulls — kept as-is (MAR detected or intentional).' FROM d_part
UNION ALL SELECT 'price', '''price'' has ' || outlier_count || ' outlier(s) (' || format('{{:.1f}}', outlier_count / n * 100) || '% of rows) — strategy ''' ||
  CASE WHEN outlier_count / n < 0.01 THEN 'remove' ELSE 'winsorise' END || ''' auto-selected; verify these are not legitimate extremes before confirming.' FROM o, n"""))
def plan_warnings_part(spark, folder):
    """The warnings of dropped and kept columns and of outliers."""
    return plan_frame(spark, plan_of(spark, folder, "d_part")).select("column", F.explode("warnings").alias("warning"))


# --- single steps over whole tables -----------------------------------------------------------

_PRICE = "CASE WHEN o_totalprice <> -9999999 THEN o_totalprice END"


def _rows(body: str) -> str:
    return f"SELECT row_no, {body} FROM d_orders"


@query("strip_text", with_views("d_orders", _rows("trim(o_orderpriority) AS o_orderpriority, trim(order_day) AS order_day")))
def strip_text(spark, folder):
    return steps.strip_text(view(spark, folder, "d_orders").select("row_no", "o_orderpriority", "order_day"))


@query("replace_sentinels", with_views("d_orders", _rows(
    f"{_PRICE} AS o_totalprice, CASE WHEN trim(o_orderpriority) NOT IN ('N/A', 'unknown') THEN trim(o_orderpriority) END AS o_orderpriority")))
def replace_sentinels(spark, folder):
    plan = plan_of(spark, folder, "d_orders")
    df = steps.strip_text(view(spark, folder, "d_orders").select("row_no", "o_totalprice", "o_orderpriority"))
    rules = {n: plan.columns[n] for n in ("o_totalprice", "o_orderpriority")}
    df = steps.replace_sentinels(df, {n: r.sentinel_values for n, r in rules.items()})
    for name, rule in rules.items():
        if rule.sentinel_table:
            df = steps.replace_sentinels_from(df, name, rule.sentinel_table)
    return df


def _price(spark, folder):
    return view(spark, folder, "d_orders").select("row_no", "o_totalprice")


def _filled(df: DataFrame, name: str, strategy: str, value=None) -> DataFrame:
    stats = steps.fill_statistics(df, {name: strategy}) if strategy in ("median", "mean", "mode") else {}
    return steps.replace_columns(df, {name: steps.fill_expression(df, name, strategy, stats.get(name), value)})


@query("fill_median", with_views("d_orders", _rows(
    "round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM d_orders)), 4) AS o_totalprice")))
def fill_median(spark, folder):
    df = _filled(_price(spark, folder), "o_totalprice", "median")
    return df.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("fill_mean", with_views("d_orders", _rows(
    "round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM d_orders)), 4) AS o_totalprice")))
def fill_mean(spark, folder):
    df = _filled(_price(spark, folder), "o_totalprice", "mean")
    return df.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("fill_mode", with_views("d_customer", """SELECT row_no, coalesce(c_mktsegment, (SELECT c_mktsegment FROM d_customer
  WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM d_customer"""))
def fill_mode(spark, folder):
    return _filled(view(spark, folder, "d_customer").select("row_no", "c_mktsegment"), "c_mktsegment", "mode")


@query("fill_literal", with_views("d_customer", "SELECT row_no, coalesce(c_mktsegment, 'NONE') AS c_mktsegment, "
                                  "coalesce(c_acctbal, 0.5) AS c_acctbal FROM d_customer"))
def fill_literal(spark, folder):
    df = view(spark, folder, "d_customer").select("row_no", "c_mktsegment", "c_acctbal")
    return _filled(_filled(df, "c_mktsegment", "fill", "NONE"), "c_acctbal", "fill", 0.5)


@query("drop_null_rows", with_views("d_customer", "SELECT row_no, c_mktsegment, c_acctbal FROM d_customer "
                                    "WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL"))
def drop_null_rows(spark, folder):
    return steps.drop_null_rows(view(spark, folder, "d_customer").select("row_no", "c_mktsegment", "c_acctbal"),
                                ["c_mktsegment", "c_acctbal"])


@query("cast_guard", with_views("d_customer", sql_union([
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, count({sql_number(c)}) AS numbers, "
    f"(count({c}) - count({sql_number(c)})) / count({c}) <= 0.05 AS safe FROM d_customer"
    for c in ("acct_text", "acct_mixed", "email")])))
def cast_guard(spark, folder):
    df = view(spark, folder, "d_customer")
    names = ("acct_text", "acct_mixed", "email")
    found = df.agg(*[c.alias(f"{n}:{k}") for n in names for k, c in steps.cast_counts(col(n), "object").items()]).first()
    rows = [(n, found[f"{n}:filled"], found[f"{n}:numbers"],
             steps.cast_is_safe(found[f"{n}:filled"], found[f"{n}:numbers"])) for n in names]
    return spark.createDataFrame(rows, "column string, filled long, numbers long, safe boolean")


@query("cast_number", with_views("d_customer", f"SELECT row_no, {sql_number('acct_text')} AS acct_text FROM d_customer"))
def cast_number(spark, folder):
    plan = Plan({"acct_text": ColumnRule("float")})
    return apply_plan(view(spark, folder, "d_customer").select("row_no", "acct_text"), plan, "row_no").df


@query("bool_cast", with_views("d_customer", """SELECT row_no, CASE WHEN lower(trim(active)) IN ('yes', 'on', '1') THEN true
  WHEN lower(trim(active)) IN ('no', 'off', '0') THEN false END AS active FROM d_customer"""))
def bool_cast(spark, folder):
    plan = Plan({"active": ColumnRule("bool")})
    return apply_plan(view(spark, folder, "d_customer").select("row_no", "active"), plan, "row_no").df


@query("date_to_iso", with_views("d_orders", _rows(f"strftime({sql_date('order_day')}, '%Y-%m-%d') AS order_day, "
                                                   "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate")))
def date_to_iso(spark, folder):
    plan = Plan({"order_day": ColumnRule("date"), "o_orderdate": ColumnRule("date")})
    return apply_plan(view(spark, folder, "d_orders").select("row_no", "order_day", "o_orderdate"), plan, "row_no").df


@query("int_recast", with_views("d_customer", f"""SELECT row_no, CAST(trunc(coalesce({sql_number('acct_text')},
  (SELECT avg({sql_number('acct_text')}) FROM d_customer))) AS BIGINT) AS acct_text FROM d_customer"""))
def int_recast(spark, folder):
    plan = Plan({"acct_text": ColumnRule("int", missing_values=MissingRule("mean"))})
    return apply_plan(view(spark, folder, "d_customer").select("row_no", "acct_text"), plan, "row_no").df


@query("drop_column", with_views("d_customer", "SELECT row_no, c_name FROM d_customer"))
def drop_column(spark, folder):
    plan = Plan({"c_mktsegment": ColumnRule(missing_values=MissingRule("drop_column"))})
    return apply_plan(view(spark, folder, "d_customer").select("row_no", "c_name", "c_mktsegment"), plan, "row_no").df


@query("leave_null", with_views("d_customer", "SELECT row_no, c_mktsegment FROM d_customer"))
def leave_null(spark, folder):
    plan = Plan({"c_mktsegment": ColumnRule(missing_values=MissingRule("leave_null"))})
    return apply_plan(view(spark, folder, "d_customer").select("row_no", "c_mktsegment"), plan, "row_no").df


_FENCES = ("(SELECT {lo} AS lower, {hi} AS upper FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"
           .format(lo=sql_round("q1 - 1.5 * (q3 - q1)", 4), hi=sql_round("q3 + 1.5 * (q3 - q1)", 4)))


def _event_fences(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    found = profile_table(df.select("value")).columns[0].outliers
    return df, {"value": (found["lower"], found["upper"])}


@query("winsorise", f"SELECT event_id, least(greatest(value, lower), upper) AS value FROM events, {_FENCES}")
def winsorise(spark, folder):
    return steps.winsorise(*_event_fences(spark, folder))


@query("remove_outliers", f"SELECT event_id, value FROM events, {_FENCES} WHERE value BETWEEN lower AND upper")
def remove_outliers(spark, folder):
    return steps.remove_outliers(*_event_fences(spark, folder))


_ORDER_COLUMNS = ", ".join(COLUMNS["d_orders"])


@query("dedup_rows", with_views("d_orders", f"SELECT min(row_no) AS row_no, {_ORDER_COLUMNS} FROM d_orders GROUP BY ALL"))
def dedup_rows(spark, folder):
    return drop_duplicates(view(spark, folder, "d_orders"), row_id="row_no")


def _subset_sql(order: str) -> str:
    return (f"SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id {order}) AS k "
            "FROM documents) WHERE k = 1")


@query("dedup_subset_first", _subset_sql("ASC"))
def dedup_subset_first(spark, folder):
    return drop_duplicates(table(spark, folder, "documents"), ["text"], "first", "doc_id")


@query("dedup_subset_last", _subset_sql("DESC"))
def dedup_subset_last(spark, folder):
    return drop_duplicates(table(spark, folder, "documents"), ["text"], "last", "doc_id")


@query("scale_min_max", """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal FROM customer,
  (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def scale_min_max(spark, folder):
    df = steps.min_max_scale(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return df.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("scale_z_score", """SELECT event_id, round((value - m) / s, 6) AS value FROM events,
  (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""")
def scale_z_score(spark, folder):
    df = steps.z_score_scale(table(spark, folder, "events").select("event_id", "value"), ["value"])
    return df.withColumn("value", F.round("value", 6))


@query("rename_columns", "SELECT p_partkey AS part_key, p_name AS part_name, p_size FROM part")
def rename_columns(spark, folder):
    plan = apply_renames(Plan({"p_partkey": ColumnRule("int"), "p_name": ColumnRule(), "p_size": ColumnRule("int")}),
                         {"p_partkey": "part_key", "p_name": "part_name", "p_size": "not a name", "gone": "x"})
    return apply_plan(table(spark, folder, "part").select("p_partkey", "p_name", "p_size"), plan, None).df


# --- custom transforms ------------------------------------------------------------------------

@query("custom_transform", with_views("d_customer", "SELECT row_no, TRY_CAST(ltrim(acct_mixed, '$') AS DOUBLE) AS acct_mixed FROM d_customer"))
def custom_transform(spark, folder):
    plan = Plan({"acct_mixed": ColumnRule("float", transform_code="ltrim('$', col)")})
    return apply_plan(view(spark, folder, "d_customer").select("row_no", "acct_mixed"), plan, "row_no").df


# expressions that are refused before anything is evaluated
_REFUSED = {
    "forbidden": "reflect('java.lang.System', 'exit', col)", "quoted": "`reflect`('java.lang.System', 'getProperty', col)",
    "method": "`java_method`('java.lang.System', 'getProperty', 'java.version')", "random": "`rand`()", "identifier": "`uuid`()",
    "clock": "current_timestamp", "today": "current_date", "now": "concat(col, timestamp 'now')", "total": "`sum`(length(col))",
    "window": "max(col) over ()", "query": "(select 'x')", "other": "c_name", "rows": "explode(array(col))", "lambda": "transform(array(col), x -> x)",
}


@query("transform_trials", with_views("d_customer", f"""SELECT 'strip' AS trial, (count(acct_mixed) - count(ltrim(acct_mixed, '$'))) / count(acct_mixed) <= 0.05 AS ok FROM d_customer
UNION ALL SELECT 'number', (count(acct_mixed) - count({sql_number('acct_mixed')})) / count(acct_mixed) <= 0.05 FROM d_customer
UNION ALL SELECT 'invent', (SELECT count(*) FROM d_customer WHERE c_mktsegment IS NULL) = 0
UNION ALL SELECT 'raise', (SELECT count(*) FROM d_customer WHERE {sql_number('acct_mixed')} IS NULL) = 0
UNION ALL SELECT 'calendar', count(*) > 0 FROM d_customer
UNION ALL SELECT unnest([{", ".join(f"'{name}'" for name in _REFUSED)}]), false"""))
def transform_trials(spark, folder):
    df = view(spark, folder, "d_customer")
    trials = {"strip": ("acct_mixed", "ltrim('$', col)"), "number": ("acct_mixed", "try_cast(col as double)"),
              "invent": ("c_mktsegment", "coalesce(col, 'x')"), "raise": ("acct_mixed", "cast(col as double)"),
              "calendar": ("email", "concat(split_part(col, '@', 1), '@', trim(both ' ' from split_part(col, '@', 2)))")}
    trials |= {name: ("acct_mixed", code) for name, code in _REFUSED.items()}
    rows = [(n, trial_transform(df, c, code)[0]) for n, (c, code) in trials.items()]
    return spark.createDataFrame(rows, "trial string, ok boolean")


@query("transform_rollback", with_views("d_customer", "SELECT row_no, acct_mixed, lower(email) AS email FROM d_customer"))
def transform_rollback(spark, folder):
    plan = Plan({"acct_mixed": ColumnRule(transform_code="try_cast(col as double)"),
                 "email": ColumnRule(transform_code="lower(col)", transform_hint="lower case")})
    return apply_plan(view(spark, folder, "d_customer").select("row_no", "acct_mixed", "email"), plan, "row_no").df


# --- the whole plan ---------------------------------------------------------------------------

# gaps that depend on another column stay; others get the median
_FILLED_PRICE = ("coalesce(o_totalprice, CASE WHEN NOT EXISTS (SELECT 1 FROM mar WHERE \"column\" = 'o_totalprice') "
                 "THEN (SELECT quantile_cont(o_totalprice, 0.5) FROM cleaned0) END)")
_APPLIED = f"""mar AS ({mar_sql('d_orders')}), cleaned0 AS (SELECT o_orderkey, o_custkey, trim(o_orderstatus) AS o_orderstatus, {_PRICE} AS o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, strftime({sql_date('order_day')}, '%Y-%m-%d') AS order_day,
    CASE WHEN trim(o_orderpriority) NOT IN ('N/A', 'unknown') THEN trim(o_orderpriority) END AS o_orderpriority FROM d_orders),
fences AS (SELECT lower, upper FROM ({_numeric_sql('d_orders', 'o_totalprice')})),
cleaned1 AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus,
    {_FILLED_PRICE} AS o_totalprice, o_orderdate, order_day,
    coalesce(o_orderpriority, (SELECT o_orderpriority FROM cleaned0 WHERE o_orderpriority IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM cleaned0, fences WHERE order_day IS NOT NULL
    AND ({_FILLED_PRICE} IS NULL OR {_FILLED_PRICE} BETWEEN lower AND upper)),
cleaned AS (SELECT (o_orderkey - (SELECT min(o_orderkey) FROM cleaned1)) / (SELECT max(o_orderkey) - min(o_orderkey) FROM cleaned1) AS o_orderkey,
    (o_custkey - (SELECT min(o_custkey) FROM cleaned1)) / (SELECT max(o_custkey) - min(o_custkey) FROM cleaned1) AS o_custkey,
    o_orderstatus, (o_totalprice - (SELECT avg(o_totalprice) FROM cleaned1)) / (SELECT stddev_pop(o_totalprice) FROM cleaned1) AS price_scaled,
    o_orderdate, order_day, o_orderpriority FROM cleaned1)"""


def _order_plan(spark, folder) -> Plan:
    return apply_renames(plan_of(spark, folder, "d_orders"), {"o_totalprice": "price_scaled"})


@query("apply_plan", with_views("d_orders", f"""WITH {_APPLIED}
SELECT round(o_orderkey, 6) AS o_orderkey, round(o_custkey, 6) AS o_custkey, o_orderstatus,
  round(price_scaled, 6) AS price_scaled, o_orderdate, order_day, o_orderpriority FROM cleaned"""))
def apply_whole_plan(spark, folder):
    df = apply_plan(view(spark, folder, "d_orders"), _order_plan(spark, folder), "row_no").df.drop("row_no")
    return df.withColumns({c: F.round(c, 6) for c in ("o_orderkey", "o_custkey", "price_scaled")})


@query("change_report", with_views("d_orders", f"""WITH {_APPLIED}, b AS (SELECT count(*) AS k FROM d_orders), a AS (SELECT count(*) AS k FROM cleaned)
SELECT b.k AS rows_before, a.k AS rows_after, b.k - a.k AS rows_dropped, 'o_totalprice' AS columns_removed FROM a, b"""))
def change_report_query(spark, folder):
    df = view(spark, folder, "d_orders")
    after = apply_plan(df, _order_plan(spark, folder), "row_no").df
    return change_report(df, after, "row_no").withColumn("columns_removed", F.array_join("columns_removed", ","))


@query("change_report_written", with_views("d_orders", f"""WITH {_APPLIED}, b AS (SELECT count(*) AS k FROM d_orders), a AS (SELECT count(*) AS k FROM cleaned)
SELECT b.k AS rows_before, a.k AS rows_after, b.k - a.k AS rows_dropped, 'o_totalprice' AS columns_removed FROM a, b"""))
def change_report_written(spark, folder):
    """The same from counts that were taken while the table was read and written."""
    done = clean(view(spark, folder, "d_orders"), _order_plan(spark, folder), row_id="row_no")
    return done.changes.withColumn("columns_removed", F.array_join("columns_removed", ","))


_AFTER_TEXTS = ("o_orderstatus", "o_orderdate", "order_day", "o_orderpriority")
_AFTER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "price_scaled", "o_orderdate", "order_day", "o_orderpriority")


def _scores(dims: str) -> str:
    return ", ".join([f"{_OVERALL} AS overall"] + [
        f"{sql_round(k, 2)} AS {k}" for k in ("completeness", "uniqueness", "validity", "consistency")]) + f" FROM {dims}"


def _before_after_ctes() -> str:
    """SQL: score inputs of the table before (b_dims) and after cleaning (a_dims)."""
    before = score_sql("d_orders")
    after = score_sql("cleaned", _AFTER_COLUMNS, _AFTER_TEXTS)
    for name in ("facts", "base", "parts", "dims"):
        before = before.replace(f"{name} AS (", f"b_{name} AS (").replace(f"FROM {name}", f"FROM b_{name}")
        after = after.replace(f"{name} AS (", f"a_{name} AS (").replace(f"FROM {name}", f"FROM a_{name}")
    return f"{_APPLIED}, {before}, {after}, b AS (SELECT {_scores('b_dims')}), a AS (SELECT {_scores('a_dims')})"


def _reports(spark, folder):
    df = view(spark, folder, "d_orders")
    before = profile_table(df, row_id="row_no", missingness=True)
    plan = apply_renames(build_plan(before), {"o_totalprice": "price_scaled"})
    after = profile_table(apply_plan(df, plan, "row_no").df, row_id="row_no")
    approved = plan.to_dict()["outliers"]
    return (score_frame(spark, score_report(before)), score_frame(spark, score_report(after, approved)))


@query("score_before_after", with_views("d_orders", f"""WITH {_before_after_ctes()},
t AS ({sql_union([f"SELECT '{k}' AS dimension, b.{k} AS before, a.{k} AS after FROM a, b" for k in eda.SCORE_KEYS])})
SELECT *, least(greatest(before, 0), 100) AS before_bar, least(greatest(after, 0), 100) AS after_bar,
  CASE WHEN round(after - before, 1) >= 0 THEN '+' ELSE '' END || format('{{:.1f}}', round(after - before, 1)) AS delta FROM t"""))
def score_before_after(spark, folder):
    return eda.compare_scores(*_reports(spark, folder))


@query("issues_before_after", with_views("d_orders", f"""WITH {_before_after_ctes()},
t AS (SELECT 'missing' AS kind, b.missing AS before, a.missing AS after FROM b_dims b, a_dims a
UNION ALL SELECT 'duplicates', b.dups, a.dups FROM b_dims b, a_dims a
UNION ALL SELECT 'type_mismatches', b.invalid, a.invalid FROM b_dims b, a_dims a
UNION ALL SELECT 'sentinel_values', (SELECT CAST(sum(sentinel_count) AS BIGINT) FROM ({_repeats_sql('d_orders', 'o_totalprice')}))
  + (SELECT count(*) FROM d_orders WHERE {sql_sentinel('o_orderpriority')}), 0
UNION ALL SELECT 'format_inconsistencies', 0, 0
UNION ALL SELECT 'outliers', (SELECT outlier_count FROM ({_numeric_sql('d_orders', 'o_totalprice')})), 0
UNION ALL SELECT 'malformed_rows', 0, 0
UNION ALL SELECT 'total_rows', b.n, a.n FROM b_dims b, a_dims a
UNION ALL SELECT 'total_columns', 7, 7)
SELECT kind, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CAST(after - before AS BIGINT) AS delta FROM t"""))
def issues_before_after(spark, folder):
    return eda.compare_issues(*_reports(spark, folder))


# --- drop impact ------------------------------------------------------------------------------

_FLAGS = f"""flags AS (SELECT row_no, o_totalprice IS NULL OR o_totalprice = -9999999 AS null_o_totalprice,
  order_day IS NULL AS null_order_day, o_orderpriority IS NULL OR o_orderpriority IN ('N/A', 'unknown') AS null_o_orderpriority,
  coalesce(o_totalprice < lower OR o_totalprice > upper, false) AS outlier_o_totalprice,
  row_number() OVER (PARTITION BY {_ORDER_COLUMNS} ORDER BY row_no) > 1 AS duplicate
  FROM d_orders, (SELECT lower, upper FROM ({_numeric_sql('d_orders', 'o_totalprice')})))"""
_CHOSEN = Strategies({"o_totalprice": "drop_row", "order_day": "drop_row", "o_orderpriority": "drop_row"},
                     {"o_totalprice": "remove"}, "drop")


@query("drop_flags", with_views("d_orders", f"WITH {_FLAGS} SELECT * FROM flags"))
def drop_flags_query(spark, folder):
    return drop_flags(view(spark, folder, "d_orders"), plan_of(spark, folder, "d_orders"), "row_no")


@query("flag_patterns", with_views("d_orders", f"""WITH {_FLAGS} SELECT null_o_totalprice, null_order_day,
  null_o_orderpriority, outlier_o_totalprice, duplicate, count(*) AS rows FROM flags GROUP BY ALL"""))
def flag_patterns_query(spark, folder):
    return flag_patterns(view(spark, folder, "d_orders"), plan_of(spark, folder, "d_orders"), "row_no")


def _impact_sql(nulls: str, outliers: str, duplicates: str) -> str:
    flags = {"null_drops": nulls, "outlier_drops": outliers, "duplicate_drops": duplicates}
    any_flag = " OR ".join(x for f in flags.values() for x in f.split() if x) or "false"
    sums = ", ".join(
        " + ".join(f"count(*) FILTER ({x})" for x in f.split()) + f" AS {k}" if f else f"CAST(0 AS BIGINT) AS {k}"
        for k, f in flags.items())
    return with_views("d_orders", f"""WITH {_FLAGS}, t AS (SELECT count(*) AS rows_before,
  count(*) FILTER ({any_flag}) AS rows_dropped, {sums} FROM flags)
SELECT rows_before, rows_dropped, rows_before - rows_dropped AS rows_after, null_drops, outlier_drops, duplicate_drops,
  greatest(0, null_drops + outlier_drops + duplicate_drops - rows_dropped) AS overlap_saved FROM t""")


@query("drop_impact", _impact_sql("null_o_totalprice null_order_day null_o_orderpriority", "outlier_o_totalprice", "duplicate"))
def drop_impact_query(spark, folder):
    return drop_impact(flag_patterns_query(spark, folder), _CHOSEN)


@query("impact_request", with_views("d_orders", f"""WITH p AS ({_plan_sql('d_orders')})
SELECT 'null' AS kind, "column", strategy FROM p WHERE strategy IS NOT NULL
UNION ALL SELECT 'outlier', "column", outlier_strategy FROM p WHERE outlier_strategy IS NOT NULL
UNION ALL SELECT 'duplicate', '', 'drop' FROM (SELECT 1)"""))
def impact_request(spark, folder):
    """The choices that a plan makes, as drop impact takes them."""
    chosen = strategies_of(plan_of(spark, folder, "d_orders"))
    rows = [("null", c, s) for c, s in chosen.nulls.items()] + [("outlier", c, s) for c, s in chosen.outliers.items()]
    return spark.createDataFrame([*rows, ("duplicate", "", chosen.duplicates)], "kind string, column string, strategy string")


def _impact_select(nulls: str, outliers: str, duplicates: str, choice: int) -> str:
    """One row of drop impact over ``flags``."""
    flags = {"null_drops": nulls, "outlier_drops": outliers, "duplicate_drops": duplicates}
    names = [x for f in flags.values() for x in f.split()]
    sums = ", ".join(("(" + " + ".join(f"count(*) FILTER ({x})" for x in f.split()) + ")" if f else "CAST(0 AS BIGINT)") + f" AS {k}" for k, f in flags.items())
    return f"""SELECT {choice} AS choice, rows_before, rows_dropped, rows_before - rows_dropped AS rows_after, null_drops, outlier_drops, duplicate_drops,
  greatest(0, null_drops + outlier_drops + duplicate_drops - rows_dropped) AS overlap_saved
FROM (SELECT count(*) AS rows_before, count(*) FILTER ({" OR ".join(names) or "false"}) AS rows_dropped, {sums} FROM flags)"""


# every choice of dropping or keeping for the five operations of the plan
_OPERATIONS = ("null_o_totalprice", "null_order_day", "null_o_orderpriority", "outlier_o_totalprice", "duplicate")
_CHOICES = [[name for k, name in enumerate(_OPERATIONS) if choice >> k & 1] for choice in range(1 << len(_OPERATIONS))]


def _of_kind(chosen: list[str], kind: str) -> list[str]:
    return [name for name in chosen if name.startswith(kind)]


@query("drop_impact_masks", with_views("d_orders", f"WITH {_FLAGS} " + sql_union([
    _impact_select(*(" ".join(_of_kind(chosen, kind)) for kind in ("null_", "outlier_", "duplicate")), choice)
    for choice, chosen in enumerate(_CHOICES)])))
def drop_impact_masks(spark, folder):
    """The effect of each choice, from one table of stored bitmaps."""
    masks = stage(flag_masks(drop_flags_query(spark, folder), "row_no"), "masks")

    def strategies(chosen: list[str]) -> Strategies:
        return Strategies({n[len("null_"):]: "drop_row" for n in _of_kind(chosen, "null_")},
                          {n[len("outlier_"):]: "remove" for n in _of_kind(chosen, "outlier_")},
                          "drop" if "duplicate" in chosen else "ignore")

    found = impacts_of_masks(masks, {str(choice): strategies(chosen) for choice, chosen in enumerate(_CHOICES)})
    return found.withColumn("choice", F.col("choice").cast("int"))


@query("mask_overlaps", with_views("d_orders", f"WITH {_FLAGS} SELECT * FROM (" + sql_union([
    f"SELECT '{min(a, b)}' AS operation, '{max(a, b)}' AS other, count(*) FILTER ({a} AND {b}) AS rows FROM flags"
    for k, a in enumerate(_OPERATIONS) for b in _OPERATIONS[k + 1:]]) + ") WHERE rows > 0"))
def mask_overlaps(spark, folder):
    return overlaps_of_masks(stage(flag_masks(drop_flags_query(spark, folder), "row_no"), "masks"))


@query("drop_impact_from_flags", _impact_sql("null_o_orderpriority", "", "duplicate"))
def drop_impact_from_flags(spark, folder):
    patterns = patterns_of_flags(drop_flags_query(spark, folder), "row_no")
    return drop_impact(patterns, Strategies({"o_orderpriority": "drop_row", "o_totalprice": "median"}, {}, "drop"))


# --- editing, comparing, sampling -------------------------------------------------------------

def _edited(plan: Plan) -> Plan:
    edit = {"columns": {
        "o_totalprice": {"note": "keep the gaps visible", "missing_values": {"strategy": "mean"}},
        "o_custkey": {"note": "nothing to fill here", "missing_values": {"strategy": "mean"}},
        "o_orderstatus": {"note": "only a note"},
        "o_orderpriority": {"note": "own category", "missing_values": {"strategy": "fill", "value": "NONE"}}},
        "outliers": {"o_totalprice": {"note": "coded gaps"}}}
    out = apply_renames(merge_edit(plan, edit), {"order_day": "day"})
    out = patch_column(out, "o_orderkey", type="string")
    return set_outlier_strategy(patch_duplicates(out, keep="last"), "o_totalprice", "keep")


_CHANGES = f"""WITH p AS ({_plan_sql('d_orders')})
SELECT 'columns' AS section, "column" AS name, 'type' AS field, type AS "from", 'string' AS "to" FROM p WHERE "column" = 'o_orderkey'
UNION ALL SELECT 'columns', "column", 'normalize', normalize, 'none' FROM p WHERE "column" = 'o_orderkey'
UNION ALL SELECT 'columns', "column", 'fill', strategy, 'mean' FROM p WHERE "column" = 'o_totalprice' AND strategy <> 'leave_null'
UNION ALL SELECT 'columns', "column", 'fill', strategy, 'fill: NONE' FROM p WHERE "column" = 'o_orderpriority'
UNION ALL SELECT 'columns', "column", 'rename_to', '—', 'day' FROM p WHERE "column" = 'order_day'
UNION ALL SELECT 'duplicates', '', 'keep', 'first', 'last' FROM p WHERE "column" = 'order_day'
UNION ALL SELECT 'outliers', "column", 'strategy', outlier_strategy, 'keep' FROM p WHERE "column" = 'o_totalprice'"""


@query("plan_compare", with_views("d_orders", _CHANGES))
def plan_compare(spark, folder):
    plan = plan_of(spark, folder, "d_orders")
    return compare_plans(spark, plan, _edited(plan))


@query("plan_change_count", with_views("d_orders", f"""SELECT count(DISTINCT CASE WHEN section = 'columns' THEN name END)
  + count(DISTINCT CASE WHEN section = 'outliers' THEN name END)
  + count(DISTINCT CASE WHEN section = 'duplicates' THEN 1 END) AS total_changes FROM ({with_views('d_orders', _CHANGES)})"""))
def plan_change_count(spark, folder):
    return total_changes(plan_compare(spark, folder))


@query("impact_labels", with_views("d_orders", f"""WITH p AS ({_plan_sql('d_orders')})
SELECT "column", CASE WHEN null_count > 0 THEN CASE strategy WHEN 'drop_row' THEN null_count || ' nulls → drop row'
  WHEN 'drop_column' THEN '→ column removed' WHEN 'leave_null' THEN null_count || ' nulls kept' ELSE null_count || ' nulls → fill with ' || strategy END END AS fill_impact,
  CASE outlier_strategy WHEN 'remove' THEN outlier_count || ' → remove rows' WHEN 'keep' THEN outlier_count || ' outliers kept' END
    AS outlier_impact FROM p"""))
def impact_labels_query(spark, folder):
    return impact_labels(plan_frame(spark, plan_of(spark, folder, "d_orders")))


@query("sample_rows", with_views("d_customer", """WITH t AS (SELECT row_no, c_mktsegment IS NULL OR c_acctbal IS NULL AS gap FROM d_customer),
n AS (SELECT count(*) AS n, count(*) FILTER (gap) AS g, greatest(least(5, count(*)), least(count(*) // 10, 25)) AS size FROM t),
a AS (SELECT row_no FROM (SELECT row_no, row_number() OVER (ORDER BY row_no) - 1 AS k FROM t WHERE gap), n
  WHERE k % greatest(1, g // greatest(1, size // 3)) = 0 AND k // greatest(1, g // greatest(1, size // 3)) < greatest(1, size // 3)),
m AS (SELECT (SELECT count(*) FROM a) AS taken),
b AS (SELECT row_no FROM (SELECT row_no, row_number() OVER (ORDER BY row_no) - 1 AS k FROM t WHERE row_no NOT IN (SELECT row_no FROM a)), n, m
  WHERE k % greatest(1, (n - taken) // (size - taken)) = 0 AND k // greatest(1, (n - taken) // (size - taken)) < size - taken)
SELECT d.* FROM d_customer d WHERE row_no IN (SELECT row_no FROM a UNION ALL SELECT row_no FROM b)"""))
def sample_rows_query(spark, folder):
    return sample_rows(view(spark, folder, "d_customer"), "row_no")


@query("column_samples", with_views("d_customer", sql_union([
    f"SELECT '{c}' AS \"column\", string_agg(v, '|' ORDER BY row_no) AS sample FROM (SELECT CAST({c} AS VARCHAR) AS v, row_no "
    f"FROM d_customer WHERE {c} IS NOT NULL ORDER BY row_no LIMIT 3)" for c in COLUMNS["d_customer"]])))
def column_samples_query(spark, folder):
    found = column_samples(view(spark, folder, "d_customer"), row_id="row_no")
    return spark.createDataFrame([(c, "|".join(v)) for c, v in found.items()], "column string, sample string")


@query("preview_rows", with_views("d_orders", f"SELECT row_no, {_ORDER_COLUMNS} FROM d_orders ORDER BY row_no LIMIT 20"))
def preview_rows(spark, folder):
    return preview(view(spark, folder, "d_orders"), row_id="row_no")
