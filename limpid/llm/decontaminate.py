"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is found in a document if at least ``threshold`` of its distinct shingles occur there. The
Jaccard similarity of a short item and a long document is close to 0, so a signature of the document
says nothing. The search therefore sketches the items only, and partitions them by size: an item
with n shingles keeps its s smallest shingle hashes (a bottom-s MinHash sketch), where s is one more
than the number of shingles an item of its size may miss. A document that contains the item must
then hold at least one value of the sketch, so the search loses nothing, and s stays a fifth of n.

Documents are probed shingle by shingle, by an equality join of hashes with the sketches. Spark
broadcasts the sketches if they are below its size threshold, and otherwise shuffles both sides, splitting hot hashes.
Texts do not take part in this join: only the candidates' texts are read again, and each candidate is
verified by the exact containment of shingle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.session import stage

SHINGLE_WORDS = 5
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def _starts(words: Column, size: int) -> Column:
    """Positions of the shingles; texts shorter than a shingle have one, empty ones none."""
    last = F.greatest(F.size(words) - size, F.lit(0))
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.array_join(F.slice(words, at + 1, F.lit(size)), " ")


def _hash(words: Column, at: Column, size: int) -> Column:
    """Hash of the shingle at a place; beyond the end of a short text nothing is added."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def item_sketches(items: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, item_shingles, size_class, sketch) of the items with at least one word.

    The sizes are partitioned by powers of two: the sketch of a class is long enough for its largest
    size, and never longer than the item. An item without words is in no document.
    """
    cut = (items.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
           .select("item_id", F.array_distinct(F.transform(_starts(F.col("w"), shingle_words), lambda i: _shingle(F.col("w"), i, shingle_words))).alias("item_shingles"),
                   F.array_sort(F.array_distinct(F.transform(_starts(F.col("w"), shingle_words), lambda i: _hash(F.col("w"), i, shingle_words)))).alias("hashes")))
    size_class = F.ceil(F.log2(F.size("item_shingles"))).cast("int")
    largest = F.pow(F.lit(2.0), size_class)
    length = F.least(largest - F.ceil(largest * threshold - 1e-9) + 1, F.size("hashes")).cast("int")
    return (cut.withColumn("size_class", size_class)
            .select("item_id", "item_shingles", "size_class", F.slice("hashes", F.lit(1), length).alias("sketch")))


def contaminated(docs: DataFrame, items: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document that contains an item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Null and
    empty texts contain nothing and are contained in nothing; a text shorter than a shingle is one
    shingle. Rows that share a doc_id are searched one by one, and the best of them counts; so does
    the best of several items with one item_id. Null ids are ids like any other.
    """
    sketches = stage(item_sketches(items, shingle_words, threshold).distinct(), "item-sketches")
    sketch = sketches.select("item_id", F.explode("sketch").alias("hash")).distinct()
    docs = docs.select("doc_id", "text")
    w = F.col("w")
    probes = (docs.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("w"))
              .select("doc_id", "digest", F.explode(F.transform(_starts(w, shingle_words), lambda i: _hash(w, i, shingle_words))).alias("hash")))
    candidates = stage(probes.join(sketch, "hash").select("doc_id", "digest", "item_id").distinct(), "candidates")
    named = (candidates.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("item_id")).alias("item_ids"))
             .withColumnsRenamed({"doc_id": "__id", "digest": "__digest"}))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__digest"))
    read = docs.join(named, same).select("doc_id", words_of(F.col("text")).alias("w"), "item_ids")
    cut = F.array_distinct(F.transform(_starts(w, shingle_words), lambda i: _shingle(w, i, shingle_words)))
    pairs = read.select("doc_id", cut.alias("doc_shingles"), F.explode("item_ids").alias("asked"))
    shared = F.size(F.array_intersect("doc_shingles", "item_shingles"))
    found = (pairs.join(sketches.select("item_id", "item_shingles"), F.col("asked.item_id").eqNullSafe(F.col("item_id")))
             .select("doc_id", "item_id", shared.alias("n_shared"), F.size("item_shingles").alias("n_item"))
             .where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9)))
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


def without_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay. Null ids are compared as equal."""
    found = contaminated(docs, items, **settings).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__found"]), "left_anti")


def op1_benchmark_decontamination(spark, folder: str) -> DataFrame:
    """Every document that contains a benchmark item, with the exact containment."""
    return contaminated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


QUERIES = {"op1_benchmark_decontamination": op1_benchmark_decontamination}

_SHINGLES = """
SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
  FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}) WHERE len(w) > 0)"""

SQL = {"op1_benchmark_decontamination": f"""
WITH d AS ({_SHINGLES.format(key='doc_id', table='documents')}), b AS ({_SHINGLES.format(key='item_id', table='benchmark')}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(any_value(n_item) AS INTEGER) AS n_item,
  count(*) / any_value(n_item) AS containment
FROM d JOIN b USING (shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(n_item) * 0.8 - 1e-9)"""}
