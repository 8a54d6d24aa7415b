"""Views over the given tables, and SQL fragments for the equivalent queries.

The given tables have no gaps, so each view dirties a whole table by rules on its key. The text of a
view is one SQL that both engines accept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limpid.functions.constants import BOOL_LIKE, PATTERNS, CASE_FREE_PATTERNS, SENTINEL_WORDS

_ORDERS = """
SELECT o_orderkey * 2 + {copy} AS row_no, o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL
       WHEN o_orderkey % 97 = 0 THEN CAST(-9999999 AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 41 = 0 THEN 'not known'
       WHEN o_orderkey % 10 = 0 THEN
         CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_day,
  CASE WHEN o_orderkey % 29 = 0 THEN ' N/A ' WHEN o_orderkey % 31 = 0 THEN 'unknown'
       ELSE o_orderpriority END AS o_orderpriority
FROM orders"""

VIEWS = {
    # gaps, coded gaps, placeholder words, two date formats, and repeated rows
    "d_orders": _ORDERS.format(copy=0) + "\nUNION ALL" + _ORDERS.format(copy=1) + " WHERE o_orderkey % 50 = 0",
    # numbers as text, mixed formats, broken addresses, yes/no words, gaps that depend on the nation
    "d_customer": """
SELECT c_custkey AS row_no, c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 23 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS acct_text,
  CASE WHEN c_custkey % 23 = 0 THEN 'n/a' WHEN c_custkey % 3 = 0 THEN '$' || CAST(c_acctbal AS STRING)
       ELSE CAST(c_acctbal AS STRING) END AS acct_mixed,
  CASE WHEN c_custkey % 19 = 0 THEN 'broken ' || c_name
       ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
  CASE WHEN c_custkey % 7 = 0 THEN 'Yes' WHEN c_custkey % 7 = 1 THEN 'no' WHEN c_custkey % 7 = 2 THEN 'ON'
       ELSE '0' END AS active,
  CASE WHEN c_nationkey < 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal
FROM customer""",
    # an empty column, gaps that depend on the size, and a few prices far out
    "d_part": """
SELECT p_partkey AS row_no, p_partkey, CASE WHEN p_partkey < 0 THEN p_brand END AS p_brand,
  CASE WHEN p_size > 25 THEN NULL ELSE p_type END AS p_type, p_size,
  CASE WHEN p_partkey % 150 = 0 THEN CAST(p_partkey AS DOUBLE) * 100000 ELSE p_retailprice END AS price
FROM part""",
    # orders stand in for runs, customers for files
    "runs": """
SELECT o_orderkey AS run_id, o_custkey AS file_id, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'P' THEN 'AWAITING_REVIEW'
       ELSE 'FAILED' END AS status
FROM orders""",
    "files": """
SELECT c_custkey AS file_id, c_nationkey AS user_id, c_name AS original_filename,
  CAST(floor(c_acctbal) AS BIGINT) AS file_size, DATE '1990-01-01' + CAST(c_custkey AS INT) AS uploaded_at
FROM customer""",
}

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view as a DataFrame; its source tables are passed by name, no catalog entry is made."""
    text = VIEWS[name]
    used = [t for t in _TABLES if f"FROM {t}" in text]
    for t in used:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(text, **{t: table(spark, folder, t) for t in used})


def with_views(names: str, body: str) -> str:
    """SQL text with the named views in front."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


# --- SQL fragments: the cell tests of the library for the text that occurs in the views ---

def sql_number(c: str) -> str:
    return (f"(CASE WHEN regexp_full_match({c}, '\\s*[+-]?(\\d+\\.?\\d*([eE][+-]?\\d+)?|\\.\\d+([eE][+-]?\\d+)?)\\s*') "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END)")


def sql_date(c: str) -> str:
    return (f"(CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST({c} AS DATE) "
            f"WHEN regexp_full_match({c}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') "
            f"THEN CAST(try_strptime({c}, '%m/%d/%Y') AS DATE) "
            f"WHEN regexp_full_match({c}, '\\d{{4}}') THEN TRY_CAST({c} || '-01-01' AS DATE) END)")


def sql_round(x: str, digits: int) -> str:
    """Rounding of the exact binary value, as reports round (``round`` works on the decimal text)."""
    return f"CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def sql_words(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_bool_like(c: str) -> str:
    return f"({c} IN {sql_words(BOOL_LIKE)})"


def sql_sentinel(c: str) -> str:
    return f"(lower(trim({c})) IN {sql_words(SENTINEL_WORDS)})"


def sql_pattern(c: str, name: str) -> str:
    options = ", 'i'" if name in CASE_FREE_PATTERNS else ""
    return f"regexp_full_match({c}, '{PATTERNS[name]}'{options})"


def sql_first_pattern(counts: dict[str, str], filled: str) -> str:
    """Name of the first pattern that more than half of the cells have."""
    return "(CASE " + " ".join(f"WHEN {n} > 0.5 * {filled} THEN '{p}'" for p, n in counts.items()) + " END)"


def sql_union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
