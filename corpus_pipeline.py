"""Training corpus from raw documents: five stages, each an operator of ``limpid.llm``.

A stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.llm.decontaminate import without_contaminated
from limpid.llm.language import UNKNOWN, fit_language, with_language
from limpid.llm.packing import packed_documents, vocabulary_path
from limpid.llm.simhash import keep_one_of_each
from limpid.llm.substrings import without_repeats
from limpid.session import stage


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language, with the predicted one as their ``lang``: those without any letter, or without text, go.

    Repeated rows stay, and a null id is kept as it is.
    """
    found = with_language(docs, fit_language(docs), to="__lang", score="__score")
    return found.where(F.col("__lang") != UNKNOWN).select(
        *[F.col("__lang").alias("lang") if c == "lang" else docs[c] for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near duplicates."""
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the words of windows that an earlier document has; n_chars follows the text."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of at most 2048 ids."""
    return packed_documents(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# language identification, SimHash and packing cannot be written as SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
