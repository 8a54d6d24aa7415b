"""Queries on the ledger, on CSV input and output, and on arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.catalog.profiling import _INVALID as INVALID
from limpid.catalog.profiling import _MATCHED, _OVERALL, text_facts
from limpid.catalog.views import sql_round, sql_union, table, view, with_views
from limpid.functions.coerce import col
from limpid.operators.apply import apply_plan
from limpid.operators.duplicates import drop_duplicates
from limpid.operators.masks import numbered
from limpid.plans.model import Plan
from limpid.session import fresh_path
from limpid.sources import ledger
from limpid.sources.csv import preview_csv, read_csv
from limpid.sources.tables import ROW_ID, read_parquet, write_cleaned, write_raw
from limpid.streaming.arrivals import analyse_arrivals

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


_NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1)"
_TOP_USER = "(SELECT user_id FROM files GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_TOP_FILE = "(SELECT file_id FROM runs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
NOW = "2001-07-20 12:00:00"


def _busiest(df, key: str):
    return df.groupBy(key).count().orderBy(F.desc("count"), key).first()[0]


@query("files_with_latest_run", with_views("files runs", f"""SELECT f.*, r.run_id, r.status AS run_status, r.created_at AS run_created_at
FROM files f LEFT JOIN {_NEWEST} r ON r.file_id = f.file_id"""))
def files_with_latest_run(spark, folder):
    return ledger.files_with_latest_run(view(spark, folder, "files"), view(spark, folder, "runs"))


@query("latest_run_per_file", with_views("runs", f"SELECT run_id, file_id, created_at, status FROM {_NEWEST}"))
def latest_run_per_file(spark, folder):
    return ledger.latest_run(view(spark, folder, "runs"))


@query("files_page", with_views("files runs", f"""WITH page AS (SELECT * FROM files WHERE user_id = {_TOP_USER}
ORDER BY uploaded_at DESC, file_id LIMIT 50 OFFSET 5)
SELECT f.*, r.run_id, r.status AS run_status, r.created_at AS run_created_at
FROM page f LEFT JOIN {_NEWEST} r ON r.file_id = f.file_id"""))
def files_page(spark, folder):
    files = view(spark, folder, "files")
    return ledger.page_with_latest_run(files, view(spark, folder, "runs"), _busiest(files, "user_id"), skip=5, limit=50)


@query("runs_of_file", with_views("runs", f"SELECT * FROM runs WHERE file_id = {_TOP_FILE}"))
def runs_of_file(spark, folder):
    runs = view(spark, folder, "runs")
    return ledger.runs_of_file(runs, _busiest(runs, "file_id"))


@query("owned_runs", with_views("files runs", f"SELECT r.* FROM runs r JOIN files f ON r.file_id = f.file_id WHERE f.user_id = {_TOP_USER}"))
def owned_runs(spark, folder):
    files = view(spark, folder, "files")
    return ledger.owned_runs(view(spark, folder, "runs"), files, _busiest(files, "user_id"))


@query("run_state", with_views("runs", """SELECT run_id, status,
  CASE WHEN status IN ('COMPLETED', 'FAILED') THEN created_at + INTERVAL 2 DAY END AS completed_at FROM runs"""))
def run_state(spark, folder):
    runs = view(spark, folder, "runs").withColumn("completed_at", F.lit(None).cast("timestamp_ntz"))
    steps = F.array(*[F.struct(s.alias("status"), F.lit(d).alias("day")) for s, d in (
        (F.lit("PENDING"), 0), (F.lit("ANALYZING"), 1), (F.col("status"), 2))])
    events = runs.withColumn("step", F.explode(steps)).select(
        "run_id", F.col("step.status").alias("status"), "completed_at",
        (F.col("created_at") + F.make_dt_interval(F.col("step.day"))).alias("at"))
    return ledger.run_state(events).select("run_id", "status", "completed_at")


@query("expiry_flags", with_views("runs", f"""SELECT run_id, created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS source_expired,
  status = 'COMPLETED' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY AS result_expired FROM runs"""))
def expiry_flags(spark, folder):
    now = F.lit(NOW).cast("timestamp_ntz")
    return ledger.expiry_flags(view(spark, folder, "runs"), now).select("run_id", "source_expired", "result_expired")


@query("recency_groups", with_views("runs", f"""WITH t AS (SELECT CAST(TIMESTAMP '{NOW}' AS DATE) AS today)
SELECT CASE WHEN CAST(created_at AS DATE) >= today THEN 'Today' WHEN CAST(created_at AS DATE) >= today - 1 THEN 'Yesterday'
  WHEN CAST(created_at AS DATE) >= today - 7 THEN 'Last 7 days' ELSE 'Older' END AS bucket, count(*) AS runs, max(created_at) AS newest
FROM runs, t GROUP BY 1"""))
def recency_groups(spark, folder):
    return ledger.recency_groups(view(spark, folder, "runs"), F.lit(NOW).cast("timestamp_ntz"))


@query("recency_members", with_views("runs", f"""WITH t AS (SELECT CAST(TIMESTAMP '{NOW}' AS DATE) AS today)
SELECT run_id, CASE WHEN CAST(created_at AS DATE) >= today THEN 'Today' WHEN CAST(created_at AS DATE) >= today - 1 THEN 'Yesterday'
  WHEN CAST(created_at AS DATE) >= today - 7 THEN 'Last 7 days' ELSE 'Older' END AS bucket FROM runs, t"""))
def recency_members(spark, folder):
    return ledger.recency_members(view(spark, folder, "runs"), F.lit(NOW).cast("timestamp_ntz")).select("run_id", "bucket")


# --- CSV --------------------------------------------------------------------------------------

_CSV_COLUMNS = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "acct_text": "double",
                "acct_mixed": "string", "email": "string", "active": "string", "c_mktsegment": "string", "c_acctbal": "double"}


def _customer_csv(spark, folder) -> str:
    """The dirtied customers as CSV; every 37th record has one field too many."""
    df = view(spark, folder, "d_customer").select(*_CSV_COLUMNS)
    name = F.when(F.col("c_custkey") % 37 == 0, F.concat("c_name", F.lit(",extra"))).otherwise(F.col("c_name"))
    path = fresh_path(spark, "customers")
    df.withColumn("c_name", name).write.option("header", True).option("quote", "").csv(path)
    return path


@query("csv_malformed", with_views("d_customer", sql_union([
    f"""SELECT '{c}' AS "column", '{t}' AS type, count({f"nullif({c}, 'n/a')" if t == 'string' or c == 'acct_text' else c}) AS filled,
  (SELECT count(*) FROM d_customer WHERE c_custkey % 37 = 0) AS malformed_rows FROM d_customer WHERE c_custkey % 37 <> 0"""
    for c, t in _CSV_COLUMNS.items()])))
def csv_malformed(spark, folder):
    parsed = read_csv(spark, _customer_csv(spark, folder))
    counts = parsed.df.agg(*[F.count(col(c)).alias(c) for c in _CSV_COLUMNS]).first()
    kinds = dict(parsed.df.dtypes)
    return spark.createDataFrame(
        [(c, kinds[c], counts[c], parsed.malformed_rows) for c in _CSV_COLUMNS],
        "column string, type string, filled long, malformed_rows long")


@query("csv_rows", with_views("d_customer", """SELECT c_custkey, c_name, c_nationkey, TRY_CAST(acct_text AS DOUBLE) AS acct_text,
  nullif(acct_mixed, 'n/a') AS acct_mixed, email, active, c_mktsegment, c_acctbal FROM d_customer WHERE c_custkey % 37 <> 0"""))
def csv_rows(spark, folder):
    return read_csv(spark, _customer_csv(spark, folder)).df.drop(ROW_ID)


@query("csv_headerless", """SELECT s_suppkey AS col_0, s_name AS col_1, s_nationkey AS col_2, s_acctbal AS col_3 FROM supplier""")
def csv_headerless(spark, folder):
    path = fresh_path(spark, "suppliers")
    table(spark, folder, "supplier").write.option("header", False).csv(path)
    return read_csv(spark, path, has_header=False).df.drop(ROW_ID).select(
        "col_0", "col_1", F.col("col_2").cast("int").alias("col_2"), "col_3")


@query("cleaned_csv", "SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def cleaned_csv(spark, folder):
    cleaned = apply_plan(table(spark, folder, "part").drop("p_brand"), Plan(), None).df
    path = write_cleaned(cleaned, fresh_path(spark, "curated"), "part", "run")
    return read_csv(spark, path).df.drop(ROW_ID).withColumn("p_size", F.col("p_size").cast("int"))


@query("csv_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_documents(spark, folder):
    """Texts with line breaks, quotes and commas, written as CSV and read back."""
    path = write_raw(table(spark, folder, "documents"), fresh_path(spark, "raw"), "documents", "documents.csv")
    return read_csv(spark, path).df.drop(ROW_ID)


@query("csv_documents_split", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_documents_split(spark, folder):
    """The texts in CSV files, one per task that read them, which are read by blocks: quoted cells run over the ends of lines and blocks."""
    path = write_raw(table(spark, folder, "documents"), fresh_path(spark, "raw"), "documents", "documents.csv")
    return read_csv(spark, path, block_bytes=1 << 18).df.drop(ROW_ID)


@query("preview_folder", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20")
def preview_folder(spark, folder):
    """First rows of a folder of many small files, the first of which has a header only."""
    rows = table(spark, folder, "customer").select("c_custkey", "c_name")
    path = fresh_path(spark, "small-files")
    files = rows.repartitionByRange(200, "c_custkey").sortWithinPartitions("c_custkey")
    spark.createDataFrame([], rows.schema).coalesce(1).union(files).write.option("header", True).csv(path)
    return preview_csv(spark, path)


@query("cleaned_row_order", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer")
def cleaned_row_order(spark, folder):
    """A cleaned table keeps the order of its rows, whatever shuffled them on the way."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias(ROW_ID), "c_custkey", "c_name")
    path = write_cleaned(drop_duplicates(rows, row_id=ROW_ID), fresh_path(spark, "curated"), "customer", "run")
    back = read_csv(spark, path).df
    return numbered(back, "position").select("c_custkey", "c_name", "position")


@query("parquet_row_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part")
def parquet_row_order(spark, folder):
    return read_parquet(spark, f"{folder}/part.parquet").select("p_partkey", F.col(ROW_ID).alias("position"))


# --- arriving files ---------------------------------------------------------------------------

_LANDED = ["o_orderkey", "o_custkey", "o_totalprice", "order_day", "o_orderpriority"]
_PER_FILE = f"""landed AS (SELECT o_orderstatus || '-' || (o_orderkey % 20) AS file, {", ".join(_LANDED)} FROM d_orders),
facts AS ({sql_union([text_facts("landed", [c]).replace("SELECT ", "SELECT file, ", 1) + " GROUP BY file" for c in ("order_day", "o_orderpriority")])}),
texts AS (SELECT file, CAST(sum({INVALID}) AS BIGINT) AS invalid, CAST(sum(filled - {_MATCHED}) AS BIGINT) AS inconsistent FROM facts GROUP BY file),
copies AS (SELECT file, CAST(sum(n - 1) AS BIGINT) AS dups FROM (SELECT file, count(*) AS n FROM landed GROUP BY file, {", ".join(_LANDED)}) GROUP BY file),
base AS (SELECT file, count(*) AS n, count(*) * {len(_LANDED)} AS cells, {" + ".join(f"count(*) - count({c})" for c in _LANDED)} AS missing
  FROM landed GROUP BY file),
dims AS (SELECT file, n, missing, dups, invalid, (1 - missing / cells) * 100 AS completeness, (1 - dups / n) * 100 AS uniqueness,
  {sql_round('(cells - missing - invalid) / cells * 100', 2)} AS validity, {sql_round('(1 - inconsistent / cells) * 100', 2)} AS consistency
  FROM base JOIN copies USING (file) JOIN texts USING (file))"""


def _landed(spark, folder) -> str:
    """The dirtied orders as many CSV files: one per status and remainder of the key."""
    path = fresh_path(spark, "landing")
    rows = view(spark, folder, "d_orders").select(
        F.concat_ws("-", "o_orderstatus", (F.col("o_orderkey") % 20).cast("string")).alias("file"), *_LANDED)
    (rows.repartition(8, "file").write.partitionBy("file").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@query("stream_analyse", with_views("d_orders", f"""WITH {_PER_FILE}
SELECT file, 'AWAITING_REVIEW' AS status, n AS total_rows, missing, dups AS duplicates, invalid AS type_mismatches, {_OVERALL} AS overall FROM dims"""))
def stream_analyse(spark, folder):
    """Dirtied orders land as many files; a micro-batch is profiled by one set of jobs and leaves a run per file in the ledger."""
    books, checkpoint = (fresh_path(spark, n) for n in ("ledger", "stream"))
    analyse_arrivals(spark, _landed(spark, folder), books, checkpoint).awaitTermination()
    found = ledger.Ledger(spark, books)
    scores = F.from_json("scores_before", "total_rows long, overall double, issues_found struct<missing:long,duplicates:long,type_mismatches:long>")
    files = found.files().select("file_id", F.regexp_extract("raw_path", "file=([^/]+)/", 1).alias("file"))
    return (found.runs().join(files, "file_id").select("file", "status", scores.alias("s"))
            .select("file", "status", "s.total_rows", "s.issues_found.*", "s.overall"))
