"""URL filters from dated lists, by a temporal list join.

A list is a table of dated entries. The entries of one key (list, scope, value), ordered by date,
become validity intervals: an entry holds from its date until the next entry of its key. A capture
is judged by the entries that were active when it was fetched, found by an as-of join: captures and
interval starts are ordered by time under each key, and every capture takes the last start before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A key is dealt over this many partitions of the as-of join; its entries are copied to each.
SALTS = 32
ACTIONS = ("remove", "block", "allow")
SCOPES = ("domain", "host", "prefix")


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and trailing dots; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """All (scope, value) keys that an entry may have to match the URL.

    domain: the host and every parent domain; host: the host alone; prefix: the host with one or
    more leading path segments. Null or unreadable URLs have no key.
    """
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    key = lambda scope, value: F.struct(F.lit(scope).alias("scope"), value.alias("value"))
    domains = F.transform(labels, lambda _, i: key("domain", F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    prefixes = F.transform(segments, lambda _, i: key(
        "prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/"))))
    return F.when(host != "", F.concat(F.array(key("host", host)), domains, prefixes))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, scope, value, action, valid_from, valid_to) from (list_name, scope, value, action, dated).

    valid_to is null while an entry is the last of its key. A ``remove`` ends its key and opens no
    interval. Of entries with one key and date the later in ACTIONS counts. Entries with a null in
    scope, value, dated or an unknown action say nothing.
    """
    known = entries.where(F.col("action").isin(*ACTIONS)).where("scope is not null and value is not null and dated is not null")
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    one = (known.groupBy("list_name", "scope", "value", "dated")
           .agg(F.max(F.struct(rank.alias("rank"), "action")).alias("last")))
    after = Window.partitionBy("list_name", "scope", "value").orderBy("dated")
    return (one.withColumn("valid_to", F.lead("dated").over(after)).where("last.action <> 'remove'")
            .select("list_name", "scope", "value", F.col("last.action").alias("action"),
                    F.col("dated").alias("valid_from"), "valid_to"))


def judge_urls(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """(url, fetched_at, verdict, list_name, scope, value, valid_from) per distinct (url, fetched_at).

    The most specific active entry decides: longest prefix, then host, then longest domain; between
    lists ``allow`` beats ``block``, then the smaller list name. Without an active entry the verdict
    is ``none``. Captures with a null URL or time match nothing. Equal captures are judged once, a
    hot key is dealt over ``salts`` partitions, and each partition is one ordered pass.
    """
    asked = captures.select("url", "fetched_at").distinct()
    wanted = (asked.where("fetched_at is not null").withColumn("key", F.explode(url_keys(F.col("url"))))
              .select("key.scope", "key.value", F.pmod(F.xxhash64("url", "fetched_at"), F.lit(salts)).cast("int").alias("salt"),
                      F.col("fetched_at").alias("at"), F.lit(1).alias("kind"), "url"))
    spans = validity_intervals(entries)
    start = F.struct("list_name", "action", "valid_from", "valid_to").alias("entry")
    begun = spans.select("scope", "value", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                         F.col("valid_from").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), start)
    # one as-of line per list: each capture key is asked once for every list that has the key
    lists = spans.select("scope", "value", "list_name").distinct()
    asks = wanted.join(lists, ["scope", "value"])
    line = Window.partitionBy("list_name", "scope", "value", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = (begun.withColumn("list_name", F.col("entry.list_name"))
            .unionByName(asks, allowMissingColumns=True))
    active = (both.withColumn("entry", F.last("entry", ignorenulls=True).over(line)).where("kind = 1")
              .where("entry is not null and (entry.valid_to is null or at < entry.valid_to)"))
    grade = F.struct(F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope")).alias("s"), F.length("value").alias("l"),
                     (F.col("entry.action") == "allow").alias("a"))
    best = (active.select("url", F.col("at").alias("fetched_at"), grade.alias("grade"), "list_name", "scope", "value", "entry")
            .groupBy("url", "fetched_at", "grade")
            .agg(F.min(F.struct("list_name", "scope", "value", F.col("entry.action").alias("action"),
                                F.col("entry.valid_from").alias("valid_from"))).alias("hit"))
            .groupBy("url", "fetched_at").agg(F.max_by("hit", "grade").alias("hit")))
    same = asked["url"].eqNullSafe(best["url"]) & asked["fetched_at"].eqNullSafe(best["fetched_at"])
    return asked.join(best, same, "left").select(
        asked["url"], asked["fetched_at"], F.coalesce("hit.action", F.lit("none")).alias("verdict"),
        "hit.list_name", "hit.scope", "hit.value", "hit.valid_from")


def filter_urls(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """``captures`` (url, fetched_at, ...) without the rows whose verdict is ``block``; columns stay."""
    bad = judge_urls(captures, entries, salts).where("verdict = 'block'").select(
        F.col("url").alias("__url"), F.col("fetched_at").alias("__at"))
    return captures.join(bad, (captures["url"] == F.col("__url")) & (captures["fetched_at"] == F.col("__at")), "left_anti")


# The given tables hold no list and no fetch times; both are derived from the pages by one rule per
# key, as SQL that both engines accept. Every host, its domain and its sections get three dated entries.
_CAPTURES = "SELECT page_id, url, CAST(1704067200 + (page_id * 7919) % 43200 * 60 AS BIGINT) AS fetched_at FROM pages"
_KEYED = """
SELECT scope, value, length(value) * 5 + ascii(substring(value, 3, 1)) * 3 + ascii(substring(value, 7, 1)) AS c
FROM (SELECT DISTINCT scope, value FROM (
  SELECT 'host' AS scope, host AS value FROM hosts
  UNION ALL SELECT 'domain' AS scope, regexp_extract(host, '([a-z-]+[.][a-z-]+[.][a-z]+)$', 1) AS value FROM hosts
  UNION ALL SELECT 'prefix' AS scope, host || '/' || section AS value FROM hosts) AS named) AS counted"""
_ENTRIES = " UNION ALL ".join(f"""
SELECT CASE WHEN c % 2 = 0 THEN 'public' ELSE 'local' END AS list_name, scope, value,
  CASE WHEN (c + {step}) % 3 = 0 THEN 'block' WHEN (c + {step}) % 3 = 1 THEN 'allow' ELSE 'remove' END AS action,
  CAST(1704067200 + ({step} * 10 + c % 9) * 86400 AS BIGINT) AS dated
FROM ({_KEYED}) AS keyed""" for step in range(3))
_HOSTS = """SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS section FROM pages"""


def op8_url_list_join(spark, folder: str) -> DataFrame:
    """Verdict of every page under the entries that were active at its fetch time."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    captures = spark.sql(_CAPTURES.replace("pages", "{pages}"), pages=pages)
    hosts = spark.sql(_HOSTS.replace("pages", "{pages}"), pages=pages)
    entries = spark.sql(_ENTRIES.replace("FROM hosts", "FROM {hosts}"), hosts=hosts)
    found = judge_urls(captures, entries)
    found = found.withColumnsRenamed({"url": "__url", "fetched_at": "__at"})
    same = captures["url"].eqNullSafe(found["__url"]) & captures["fetched_at"].eqNullSafe(found["__at"])
    return captures.join(found, same).select(
        "page_id", "fetched_at", "verdict", "list_name", "scope", "value", "valid_from")


QUERIES = {"op8_url_list_join": op8_url_list_join}

SQL = {"op8_url_list_join": f"""
WITH captures AS ({_CAPTURES}), hosts AS ({_HOSTS}), entries AS ({_ENTRIES}),
spans AS (SELECT * FROM (SELECT *, dated AS valid_from,
    lead(dated) OVER (PARTITION BY list_name, scope, value ORDER BY dated) AS valid_to FROM entries) WHERE action <> 'remove'),
parts AS (SELECT page_id, fetched_at, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
    [s FOR s IN string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') IF s <> ''] AS segments FROM captures),
keys AS (
  SELECT page_id, fetched_at, 'host' AS scope, host AS value FROM parts
  UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(list_slice(string_split(host, '.'), i, 100), '.')
    FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM parts)
  UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(list_slice(segments, 1, i), '/')
    FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM parts)),
hits AS (SELECT k.page_id, s.list_name, s.scope, s.value, s.action, s.valid_from,
    row_number() OVER (PARTITION BY k.page_id ORDER BY
      CASE s.scope WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(s.value) DESC,
      CASE s.action WHEN 'allow' THEN 0 ELSE 1 END, s.list_name) AS place
  FROM keys k JOIN spans s ON k.scope = s.scope AND k.value = s.value
    AND s.valid_from <= k.fetched_at AND (s.valid_to IS NULL OR k.fetched_at < s.valid_to))
SELECT c.page_id, c.fetched_at, coalesce(h.action, 'none') AS verdict, h.list_name, h.scope, h.value, h.valid_from
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.place = 1"""}
