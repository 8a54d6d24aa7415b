"""Queries on profiles: scores, types, statistics, values, patterns, missingness, reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.catalog.views import (
    sql_bool_like, sql_date, sql_first_pattern, sql_number, sql_pattern, sql_round, sql_sentinel, sql_union, table,
    view, with_views,
)
from limpid.functions.constants import PATTERNS
from limpid.operators import eda
from limpid.operators.profile import profile_table, with_sentinel_tables
from limpid.operators.score import score_frame, score_report
from limpid.operators.sketches import (
    column_sketches, distinct_error, merged_sketches, rank_error, sketched_distinct, sketched_quantiles,
)
from limpid.operators.values import unpivot_cells
from limpid.session import stage

QUERIES: dict = {}
SQL: dict[str, str] = {}

TEXTS = {"d_orders": ("o_orderstatus", "order_day", "o_orderpriority"),
         "d_customer": ("c_name", "acct_text", "acct_mixed", "email", "active", "c_mktsegment")}
NATIVE = {"d_orders": ("o_orderkey", "o_custkey", "o_totalprice"),
          "d_customer": ("c_custkey", "c_nationkey", "c_acctbal")}
COLUMNS = {"d_orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "order_day",
                        "o_orderpriority"),
           "d_customer": ("c_custkey", "c_name", "c_nationkey", "acct_text", "acct_mixed", "email", "active",
                          "c_mktsegment", "c_acctbal")}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def text_facts(view_name: str, columns=None) -> str:
    """SQL: per text column the counts of the cell tests."""
    parts = []
    for c in columns or TEXTS[view_name]:
        tests = ", ".join(f"count(*) FILTER ({sql_pattern(c, p)}) AS p_{p}" for p in PATTERNS)
        parts.append(
            f"SELECT '{c}' AS col, count(*) AS total, count({c}) AS filled, count({sql_number(c)}) AS numbers, "
            f"count({sql_date(c)}) AS dates, count(*) FILTER ({sql_bool_like(c)}) AS bools, "
            f"count(*) FILTER ({sql_sentinel(c)}) AS sentinels, count(DISTINCT {c}) AS uniq, {tests} FROM {view_name}")
    return sql_union(parts)


_PATTERN_COUNTS = {p: f"p_{p}" for p in PATTERNS}
_DOMINANT = sql_first_pattern(_PATTERN_COUNTS, "filled")
_MATCHED = "(CASE " + " ".join(f"WHEN p_{p} > 0.5 * filled THEN p_{p}" for p in PATTERNS) + " ELSE filled END)"
_INVALID = ("CASE WHEN numbers > 0.5 * filled THEN filled - numbers "
            "WHEN dates > 0.5 * filled THEN filled - dates ELSE 0 END")
_CASTABLE = sql_round("numbers / filled * 100", 1)
_DETECTED = ("CASE WHEN filled = 0 THEN 'string' WHEN bools = filled THEN 'bool' WHEN numbers >= 0.8 * filled THEN 'numeric' "
             "WHEN dates >= 0.8 * filled THEN 'date' ELSE 'string' END")


def duplicates_sql(view_name: str, columns) -> str:
    cols = ", ".join(columns)
    return f"(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {view_name} GROUP BY {cols}))"


def score_sql(view_name: str, columns=None, texts=None) -> str:
    """SQL: one row with the inputs of the score."""
    cols = columns or COLUMNS[view_name]
    nulls = " + ".join(f"count(*) - count({c})" for c in cols)
    return f"""facts AS ({text_facts(view_name, texts)}),
base AS (SELECT count(*) AS n, count(*) * {len(cols)} AS cells, {nulls} AS missing FROM {view_name}),
parts AS (SELECT n, cells, missing, {duplicates_sql(view_name, cols)} AS dups,
  (SELECT CAST(sum({_INVALID}) AS BIGINT) FROM facts) AS invalid,
  (SELECT CAST(sum(filled - {_MATCHED}) AS BIGINT) FROM facts) AS inconsistent FROM base),
dims AS (SELECT *, (1 - missing / cells) * 100 AS completeness, (1 - dups / n) * 100 AS uniqueness,
  {sql_round('(cells - missing - invalid) / cells * 100', 2)} AS validity,
  {sql_round('(1 - inconsistent / cells) * 100', 2)} AS consistency FROM parts)"""


_OVERALL = sql_round("0.35 * completeness + 0.25 * uniqueness + 0.25 * validity + 0.15 * consistency", 2)
_SCORE_COLUMNS = f"{_OVERALL} AS overall, " + ", ".join(
    f"{sql_round(k, 2)} AS {k}" for k in ("completeness", "uniqueness", "validity", "consistency"))


def profile_of(spark: SparkSession, folder: str, name: str, missingness: bool = False):
    return profile_table(view(spark, folder, name), row_id="row_no", missingness=missingness)


@query("dq_score", with_views("d_orders", f"WITH {score_sql('d_orders')} SELECT {_SCORE_COLUMNS}, n AS total_rows FROM dims"))
def dq_score(spark: SparkSession, folder: str) -> DataFrame:
    report = score_report(profile_of(spark, folder, "d_orders"))
    return score_frame(spark, report).select(
        "overall", "completeness", "uniqueness", "validity", "consistency", "total_rows")


@query("validity_consistency", with_views("d_customer", f"""WITH {score_sql('d_customer')}
SELECT cells AS total_cells, missing AS missing_cells, dups AS duplicate_rows, invalid AS invalid_cells,
  validity, consistency FROM dims"""))
def validity_consistency(spark, folder):
    return profile_of(spark, folder, "d_customer").table_frame(spark).select(
        "total_cells", "missing_cells", "duplicate_rows", "invalid_cells", "validity", "consistency")


@query("column_nulls", with_views("d_customer", "WITH c AS (" + sql_union([
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
    f"{sql_round(f'(count(*) - count({c})) / count(*) * 100', 1)} AS null_pct FROM d_customer" for c in COLUMNS["d_customer"]])
    + ") SELECT *, CASE WHEN null_pct = 0 THEN 'none' WHEN null_pct < 10 THEN 'low' "
      "WHEN null_pct < 50 THEN 'medium' ELSE 'high' END AS band FROM c"))
def column_nulls(spark, folder):
    columns = profile_of(spark, folder, "d_customer").column_frame(spark)
    return eda.missing_ranking(columns).join(columns.select("column", "null_count"), "column").select(
        "column", "null_count", "null_pct", "band")


def _detection_sql(v: str) -> str:
    native = [f"SELECT '{c}', '{s}', 'numeric', 0 FROM (SELECT 1)" for c, s in
              zip(NATIVE[v], ("int", "int", "float"))]
    return f"""WITH facts AS ({text_facts(v)})
SELECT col AS "column", 'object' AS storage_type, {_DETECTED} AS detected_type,
  CAST(CASE WHEN {_DETECTED} = 'numeric' THEN filled - numbers WHEN {_DETECTED} = 'date' THEN filled - dates
       WHEN {_DETECTED} = 'string' THEN filled - {_MATCHED} ELSE 0 END AS BIGINT) AS invalid_count FROM facts
UNION ALL {sql_union(native)}"""


def _detection(spark, folder, v):
    return profile_of(spark, folder, v).column_frame(spark).filter("storage_type != 'timestamp'").select(
        "column", "storage_type", "detected_type", "invalid_count")


@query("type_detection", with_views("d_customer", _detection_sql("d_customer")))
def type_detection(spark, folder):
    return _detection(spark, folder, "d_customer")


@query("type_detection_orders", with_views("d_orders", _detection_sql("d_orders")))
def type_detection_orders(spark, folder):
    return _detection(spark, folder, "d_orders")


_NUMBERS = {"lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                         "l_discount", "l_tax"),
            "part": ("p_partkey", "p_size", "p_retailprice"), "events": ("event_id", "user_id", "value")}


def _numeric_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", min, max, {sql_round('mean', 4)} AS mean, {sql_round('median', 4)} AS median,
  {sql_round('std', 4)} AS std, {sql_round('q1', 4)} AS q1, {sql_round('q3', 4)} AS q3, lower, upper,
  (SELECT count(*) FROM {t} WHERE {c} < lower OR {c} > upper) AS outlier_count
FROM (SELECT *, {sql_round('q1 - 1.5 * (q3 - q1)', 4)} AS lower, {sql_round('q3 + 1.5 * (q3 - q1)', 4)} AS upper
  FROM (SELECT CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean,
    CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median, stddev_samp({c}) AS std,
    CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3 FROM {t}))"""


@query("numeric_profile", sql_union([_numeric_sql(t, c) for t, cs in _NUMBERS.items() for c in cs]))
def numeric_profile(spark, folder):
    s, o = F.col("stats"), F.col("outliers")
    out = None
    for t, cs in _NUMBERS.items():
        columns = profile_table(table(spark, folder, t).select(*cs)).column_frame(spark).select(
            "column", *[s[k].alias(k) for k in ("min", "max", "mean", "median", "std", "q1", "q3")],
            o["lower"].alias("lower"), o["upper"].alias("upper"), o["count"].alias("outlier_count"))
        out = columns if out is None else out.unionByName(columns)
    return out


@query("date_profile", with_views("d_orders", sql_union([
    f"SELECT '{c}' AS \"column\", strftime(min({c}), '%Y-%m-%d') AS min_date, strftime(max({c}), '%Y-%m-%d') AS max_date FROM {t}"
    for t, c in (("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate"))]
    + [f"SELECT 'order_day', strftime(min({sql_date('order_day')}), '%Y-%m-%d'), "
       f"strftime(max({sql_date('order_day')}), '%Y-%m-%d') FROM d_orders"])))
def date_profile(spark, folder):
    sources = [table(spark, folder, "orders").select("o_orderdate"), table(spark, folder, "events").select("ts"),
               table(spark, folder, "lineitem").select("l_shipdate"), view(spark, folder, "d_orders").select("order_day")]
    out = None
    for df in sources:
        rows = profile_table(df).column_frame(spark).select("column", "stats.min_date", "stats.max_date")
        out = rows if out is None else out.unionByName(rows)
    return out


def _histogram_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(b AS INTEGER) AS bin, {sql_round('lo + b * ((hi - lo) / 10)', 4)} AS lower,
  {sql_round('CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 10) END', 4)} AS upper,
  (SELECT count(*) FROM {t} WHERE {c} >= CASE WHEN b = 0 THEN lo ELSE lo + b * ((hi - lo) / 10) END
    AND (b = 9 OR {c} < lo + (b + 1) * ((hi - lo) / 10))) AS "count"
FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {t}), range(10) AS r(b)"""


@query("histogram10", sql_union([_histogram_sql(t, c) for t, c in (
    ("events", "value"), ("events", "user_id"), ("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"))]))
def histogram10(spark, folder):
    a = profile_table(table(spark, folder, "events").select("value", "user_id"))
    b = profile_table(table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity"))
    return eda.histogram_bins(a.column_frame(spark)).unionByName(eda.histogram_bins(b.column_frame(spark)))


def _repeats_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(coalesce(sum(k), 0) AS BIGINT) AS sentinel_count,
  coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY v), '') AS sentinel_values FROM (
  SELECT CAST({c} AS DOUBLE) AS v, count(*) AS k FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})
  WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1) GROUP BY 1 HAVING count(*) >= 5)"""


@query("numeric_sentinels", with_views("d_orders", sql_union([
    _repeats_sql("d_orders", "o_totalprice"), _repeats_sql("events", "value"), _repeats_sql("lineitem", "l_quantity")])))
def numeric_sentinels(spark, folder):
    out = None
    for df in (view(spark, folder, "d_orders").select("o_totalprice"), table(spark, folder, "events").select("value"),
               table(spark, folder, "lineitem").select("l_quantity")):
        found = profile_table(df).columns
        rows = [(c.column, c.sentinel_count, [_plain(v) for v in c.sentinel_values]) for c in found]
        frame = with_sentinel_tables(spark.createDataFrame(rows, "column string, sentinel_count long, sentinel_values array<string>"),
                                     {c.column: c.sentinel_table for c in found})
        frame = frame.withColumn("sentinel_values", F.array_join("sentinel_values", ","))
        out = frame if out is None else out.unionByName(frame)
    return out


def _plain(v) -> str:
    """Number as the other engine prints it."""
    return v if isinstance(v, str) else f"{v:.1f}" if float(v).is_integer() else repr(float(v))


_STRINGS = {"d_orders": ("o_orderstatus", "o_orderpriority"), "d_customer": ("c_name", "acct_mixed", "email", "active", "c_mktsegment"),
            "part": ("p_name", "p_brand", "p_type"), "documents": ("text", "lang", "source"), "pages": ("url",)}


def _string_sql(t: str) -> str:
    words = {c: f"(SELECT coalesce(string_agg(DISTINCT trim({c}), ',' ORDER BY trim({c})), '') FROM {t} WHERE {sql_sentinel(c)})"
             for c in _STRINGS[t]}
    values = "CASE col " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in words.items()) + " END"
    return f"""SELECT '{t}' AS source, col AS "column", uniq AS unique_count,
  {sql_round('uniq / filled * 100', 1)} AS cardinality_pct, {_DOMINANT} AS pattern,
  {_CASTABLE} AS castable_pct, (numbers >= 5 AND {_CASTABLE} < 80) AS format_inconsistency,
  sentinels AS sentinel_count, {values} AS sentinel_values FROM ({text_facts(t, _STRINGS[t])})"""


@query("string_profile", with_views("d_orders d_customer", sql_union([_string_sql(t) for t in _STRINGS])))
def string_profile(spark, folder):
    out = None
    for t, cs in _STRINGS.items():
        df = (view if t.startswith("d_") else table)(spark, folder, t).select(*cs)
        rows = profile_table(df).column_frame(spark).select(
            F.lit(t).alias("source"), "column", "unique_count", "cardinality_pct", "pattern", "castable_pct",
            "format_inconsistency", "sentinel_count", F.array_join("sentinel_values", ",").alias("sentinel_values"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _top_sql(t: str, c: str, key: str) -> str:
    return f"""SELECT '{t}' AS source, '{c}' AS "column", CAST(rank AS INTEGER) AS rank, value, "count" FROM (
  SELECT {c} AS value, count(*) AS "count", row_number() OVER (ORDER BY count(*) DESC, min({key}), {c}) AS rank
  FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"""


_TOPS = {"d_orders": ("row_no", ("o_orderstatus", "o_orderpriority")), "d_customer": ("row_no", ("email", "active", "c_mktsegment")),
         "part": ("p_partkey", ("p_name", "p_brand", "p_type")), "documents": ("doc_id", ("text", "lang", "source")),
         "events": ("event_id", ("event_type", "props"))}


@query("top_values", with_views("d_orders d_customer", sql_union([
    _top_sql(t, c, key) for t, (key, cs) in _TOPS.items() for c in cs])))
def top_values(spark, folder):
    out = None
    for t, (key, cs) in _TOPS.items():
        df = (view if t.startswith("d_") else table)(spark, folder, t).select(key, *cs)
        listed = profile_table(df, row_id=key).column_frame(spark).select("column", F.posexplode("top_values"))
        rows = listed.select(F.lit(t).alias("source"), "column", (F.col("pos") + 1).alias("rank"),
                             F.col("col.value").alias("value"), F.col("col.count").alias("count"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("string_sentinels", with_views("d_orders", sql_union([
    f"SELECT '{c}' AS \"column\", trim({c}) AS value, count(*) AS cells FROM d_orders WHERE {sql_sentinel(c)} GROUP BY 2"
    for c in TEXTS["d_orders"]])))
def string_sentinels(spark, folder):
    from limpid.functions.coerce import col, is_sentinel_word, strip
    from limpid.operators.values import value_counts

    df = view(spark, folder, "d_orders")
    names = TEXTS["d_orders"]
    counts = value_counts(df, {i: F.when(is_sentinel_word(col(c)), strip(col(c))) for i, c in enumerate(names)})
    name = F.array(*[F.lit(c) for c in names])[F.col("slot")]
    return counts.select(name.alias("column"), "value", F.col("n").alias("cells"))


_PATTERN_TABLES = {"d_customer": ("c_name", "email", "acct_text", "c_mktsegment"), "pages": ("url",), "d_orders": ("order_day",)}


@query("pattern_consistency", with_views("d_customer d_orders", sql_union([
    f"""SELECT '{t}' AS source, col AS "column", filled, {', '.join(f'p_{p} AS "{p}"' for p in PATTERNS)},
  {_DOMINANT} AS pattern, CAST(filled - {_MATCHED} AS BIGINT) AS inconsistent FROM ({text_facts(t, cs)})"""
    for t, cs in _PATTERN_TABLES.items()])))
def pattern_consistency(spark, folder):
    from limpid.functions.coerce import col
    from limpid.operators.profile import dominant_pattern
    from limpid.operators.values import summarise_texts

    rows = []
    for t, cs in _PATTERN_TABLES.items():
        df = (view if t.startswith("d_") else table)(spark, folder, t)
        found = summarise_texts(df, {i: col(c) for i, c in enumerate(cs)}, 1)
        for i, c in enumerate(cs):
            counts, filled = found[i].patterns, found[i].rows
            best = dominant_pattern(counts, filled)
            rows.append((t, c, filled, *counts.values(), best, filled - counts[best] if best else 0))
    schema = "source string, column string, filled long, " + ", ".join(f"`{p}` long" for p in PATTERNS)
    return spark.createDataFrame(rows, schema + ", pattern string, inconsistent long")


def _mixed_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {sql_round(f'count({sql_number(c)}) / count({c}) * 100', 1)} AS castable_pct,
  (SELECT string_agg(v, '|' ORDER BY row_no) FROM (SELECT {c} AS v, row_no FROM d_customer
    WHERE {c} IS NOT NULL AND {sql_number(c)} IS NULL ORDER BY row_no LIMIT 3)) AS non_castable_sample FROM d_customer"""


@query("format_inconsistency", with_views("d_customer", sql_union([_mixed_sql(c) for c in ("acct_mixed", "active")])))
def format_inconsistency(spark, folder):
    columns = profile_of(spark, folder, "d_customer").column_frame(spark)
    return columns.filter("format_inconsistency").select(
        "column", "castable_pct", F.array_join("non_castable_sample", "|").alias("non_castable_sample"))


def _issues_sql(v: str, floats: tuple[str, ...]) -> str:
    """SQL: issue counts of a view; the numeric columns are given by name."""
    numeric = sql_union([_numeric_sql(v, c) for c in floats])
    repeats = sql_union([_repeats_sql(v, c) for c in floats])
    return f"""WITH {score_sql(v)}, numeric_cols AS ({numeric}), repeats AS ({repeats})
SELECT missing, dups AS duplicates, invalid AS type_mismatches,
  CAST((SELECT sum(sentinel_count) FROM repeats) + (SELECT sum(CASE WHEN {_DETECTED} IN ('string', 'bool') THEN sentinels ELSE 0 END) FROM facts) AS BIGINT) AS sentinel_values,
  CAST((SELECT count(*) FROM facts WHERE {_DETECTED} IN ('string', 'bool') AND numbers >= 5 AND {_CASTABLE} < 80) AS BIGINT) AS format_inconsistencies,
  CAST((SELECT sum(outlier_count) FROM numeric_cols) AS BIGINT) AS outliers, CAST(0 AS BIGINT) AS malformed_rows FROM dims"""


@query("issue_counts", with_views("d_orders", _issues_sql("d_orders", NATIVE["d_orders"])))
def issue_counts(spark, folder):
    report = score_report(profile_of(spark, folder, "d_orders"))
    issues = F.col("issues_found")
    return score_frame(spark, report).select(*[issues[k].alias(k) for k in report["issues_found"]])


_MAR_TEXT = ("c_name", "acct_text", "acct_mixed", "email", "active")
_MAR_GAPPY = ("c_mktsegment", "c_acctbal")


def _chi_sql(g: str, o: str) -> str:
    return f"""SELECT '{g}' AS "column", '{o}' AS other, round(sum(power(m - k * tm / tn, 2) / (k * (tm / tn) * (1 - tm / tn))), 4) AS statistic
FROM (SELECT {o}, count(*) AS k, count(*) - count({g}) AS m FROM d_customer WHERE {o} IS NOT NULL GROUP BY {o}),
  (SELECT count(*) AS tn, count(*) - count({g}) AS tm FROM d_customer WHERE {o} IS NOT NULL)"""


def _association_rows(spark, folder, test: str):
    profile = profile_of(spark, folder, "d_customer", missingness=True)
    rows = [(column, other, round(found[1], 4)) for (column, other), found in profile.association_tests.items()
            if found[0] == test and not math.isnan(found[1])]
    return spark.createDataFrame(rows, "column string, other string, statistic double")


@query("mar_chi2", with_views("d_customer", sql_union(
    [_chi_sql(g, o) for g in _MAR_GAPPY for o in _MAR_TEXT] + [_chi_sql("c_acctbal", "c_mktsegment")])))
def mar_chi2(spark, folder):
    return _association_rows(spark, folder, "chi2")


@query("mar_point_biserial", with_views("d_customer", sql_union([
    f"""SELECT '{g}' AS "column", '{o}' AS other, round(corr(CASE WHEN {g} IS NULL THEN 1.0 ELSE 0.0 END, {o}), 4) AS statistic
FROM d_customer WHERE {o} IS NOT NULL"""
    for g in _MAR_GAPPY for o in ("c_custkey", "c_nationkey", "c_acctbal") if g != o])))
def mar_point_biserial(spark, folder):
    return _association_rows(spark, folder, "point_biserial")


def mar_sql(v: str) -> str:
    """CTE body: (column, other, test, place) of the tests that reject independence at 5 percent.

    A correlation is compared with the t distribution's critical value (Cornish-Fisher series), a
    chi-square statistic with the normal approximation by its cube root (Wilson and Hilferty).
    """
    gappy = [c for c in COLUMNS[v] if c in ("c_mktsegment", "c_acctbal", "o_totalprice")]
    z = "1.959963984540054"
    critical = (f"({z} + (power({z}, 3) + {z}) / (4 * (n - 2)) + (5 * power({z}, 5) + 16 * power({z}, 3) + 3 * {z}) / (96 * power(n - 2, 2)))")
    tests = []
    for g in gappy:
        for place, o in enumerate(COLUMNS[v]):
            if o == g:
                continue
            if o in NATIVE[v]:
                tests.append(f"""SELECT '{g}' AS "column", '{o}' AS other, 'point_biserial' AS test, {place} AS place
FROM (SELECT corr(CASE WHEN {g} IS NULL THEN 1.0 ELSE 0.0 END, {o}) AS r, count(*) AS n FROM {v} WHERE {o} IS NOT NULL)
WHERE r * r * (n - 2) / (1 - r * r) > power({critical}, 2)""")
            elif o in TEXTS[v]:
                tests.append(f"""SELECT '{g}', '{o}', 'chi2', {place}
FROM (SELECT sum(power(m - k * tm / tn, 2) / (k * (tm / tn) * (1 - tm / tn))) AS x, count(*) - 1 AS df
  FROM (SELECT {o}, count(*) AS k, count(*) - count({g}) AS m FROM {v} WHERE {o} IS NOT NULL GROUP BY {o}),
    (SELECT count(*) AS tn, count(*) - count({g}) AS tm FROM {v} WHERE {o} IS NOT NULL))
WHERE (power(x / df, 1.0 / 3) - (1 - 2.0 / (9 * df))) / sqrt(2.0 / (9 * df)) > 1.6448536269514722""")
    return sql_union(tests)


@query("missing_at_random", with_views("d_customer", f"""WITH mar AS ({mar_sql('d_customer')})
SELECT "column", arg_min(other, place) AS correlated_with, arg_min(test, place) AS test FROM mar GROUP BY 1"""))
def missing_at_random(spark, folder):
    found = profile_of(spark, folder, "d_customer", missingness=True).associations
    return spark.createDataFrame([(a.column, a.correlated_with, a.test) for a in found],
                                 "column string, correlated_with string, test string")


@query("category_shares", with_views("d_orders", f"""WITH top AS ({sql_union([_top_sql('d_orders', c, 'row_no') for c in ('o_orderstatus', 'o_orderpriority')])}),
info AS ({sql_union([f"SELECT '{c}' AS col, count(DISTINCT {c}) AS uniq, count(*) - count({c}) AS nulls FROM d_orders" for c in ('o_orderstatus', 'o_orderpriority')])})
SELECT "column", rank, value, "count", round("count" / sum("count") OVER w * 100, 1) AS share_pct,
  round("count" / max("count") OVER w * 100, 1) AS bar_pct, greatest(uniq - 5, 0) AS more_values, nulls AS null_count,
  round(nulls / (sum("count") OVER w + nulls) * 100, 1) AS null_bar_pct
FROM top JOIN info ON col = "column" WINDOW w AS (PARTITION BY "column")"""))
def category_shares(spark, folder):
    return eda.category_shares(profile_of(spark, folder, "d_orders").column_frame(spark))


@query("box_plots", f"""SELECT "column", min, q1, median, q3, max,
  CASE WHEN outlier_count > 0 AND lower > min THEN lower END AS lower_mark,
  CASE WHEN outlier_count > 0 AND upper < max THEN upper END AS upper_mark FROM (
{sql_union([_numeric_sql('events', c) for c in ('event_id', 'user_id', 'value')])})""")
def box_plots(spark, folder):
    return eda.box_plots(profile_table(table(spark, folder, "events")).column_frame(spark))


@query("score_dimensions", with_views("d_customer", f"""WITH {score_sql('d_customer')}, s AS (SELECT {_SCORE_COLUMNS} FROM dims)
SELECT dimension, CAST(floor(v + 0.5) AS INTEGER) AS value FROM (
  SELECT 'completeness' AS dimension, completeness AS v FROM s UNION ALL SELECT 'uniqueness', uniqueness FROM s
  UNION ALL SELECT 'validity', validity FROM s UNION ALL SELECT 'consistency', consistency FROM s)"""))
def score_dimensions(spark, folder):
    return eda.score_by_dimension(score_frame(spark, score_report(profile_of(spark, folder, "d_customer"))))


@query("summary_figures", with_views("d_orders", f"""WITH {score_sql('d_orders')}
SELECT n AS total_rows, {len(COLUMNS['d_orders'])} AS total_columns, dups AS duplicate_rows,
  {_OVERALL} AS dq_score FROM dims"""))
def summary_figures(spark, folder):
    profile = profile_of(spark, folder, "d_orders")
    return eda.summary_figures(profile.table_frame(spark), score_frame(spark, score_report(profile)))


# --- sketches ---------------------------------------------------------------------------------

_SKETCHED = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PROBABILITIES = [0.01, 0.25, 0.5, 0.75, 0.99]
_COUNTED = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


def _stored_sketches(spark, folder, columns):
    """Sketches of eight parts of the table, stored and then merged, as those of eight files would be."""
    parts = column_sketches(table(spark, folder, "lineitem"), F.expr("pmod(l_orderkey, 8)"), columns)
    return merged_sketches(stage(parts, "sketches"))


@query("sketch_quantiles", sql_union([
    f"""SELECT '{c}' AS "column", p, count({c}) AS numbers, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, true AS within
FROM lineitem, (SELECT CAST(unnest({_PROBABILITIES}) AS DOUBLE) AS p) GROUP BY p""" for c in _SKETCHED]))
def sketch_quantiles(spark, folder):
    """Merged quantile sketches; ``within`` tells whether the rank of each quantile, counted exactly, keeps the stated bound."""
    sketches = _stored_sketches(spark, folder, _SKETCHED).cache()
    found = sketched_quantiles(sketches, _PROBABILITIES)
    cells = unpivot_cells(table(spark, folder, "lineitem"), {i: F.col(c).cast("double") for i, c in enumerate(_SKETCHED)})
    named = cells.select(F.get(F.array(*[F.lit(c) for c in _SKETCHED]), F.col("slot")).alias("column"), F.col("value").alias("cell"))
    ranked = named.join(F.broadcast(found), "column").groupBy("column", "p").agg(
        F.count("cell").alias("n"), F.count_if(F.col("cell") < F.col("value")).alias("below"),
        F.count_if(F.col("cell") <= F.col("value")).alias("upto"))
    off = F.greatest(F.col("below") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"))
    return ranked.join(sketches, "column").select("column", "p", "numbers", "low", "high", (off <= rank_error()).alias("within"))


@query("sketch_distinct", sql_union([
    f"""SELECT '{c}' AS "column", count({c}) AS filled, count(DISTINCT {c}) AS exact, true AS within FROM lineitem""" for c in _COUNTED]))
def sketch_distinct(spark, folder):
    """Merged distinct-count sketches beside the exact numbers."""
    lineitem = table(spark, folder, "lineitem")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in _COUNTED])
    exact = lineitem.select(F.explode(cells).alias("c")).groupBy("c.column").agg(F.count_distinct("c.value").alias("exact"))
    found = sketched_distinct(_stored_sketches(spark, folder, _COUNTED)).join(exact, "column")
    off = F.abs(F.col("estimate") - F.col("exact")) / F.col("exact")
    return found.select("column", "filled", "exact", (off <= distinct_error()).alias("within"))
