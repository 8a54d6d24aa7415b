"""Analyse CSV files as they arrive in a folder."""

from __future__ import annotations

import hashlib
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from limpid.run import analyse_file, analyse_files
from limpid.sources.csv import block_size
from limpid.sources.ledger import Ledger

# Files taken per micro-batch.
FILES_PER_BATCH = 500


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Stream of the paths of new CSV files. Only file metadata is read here, no content."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .load(folder).select("path", "length")
    )


def run_key(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:32]


def analyse_arrivals(
    spark: SparkSession, folder: str, ledger_folder: str, checkpoint: str, user_id: str = "",
    has_header: bool = True, flags: bool = True, multi_line: bool = True,
) -> StreamingQuery:
    """Analyse every new file once and stop when there is none left.

    A micro-batch holds at most FILES_PER_BATCH paths. Its files of at most one block are analysed
    together, by a number of jobs that does not depend on them, and committed to the ledger at once; a
    larger file is analysed by its own jobs. A batch that runs again after a crash finds its commit, and
    skips files whose run has already reached a result. A file that cannot be analysed ends as a FAILED
    run and does not hold up the others; an error of the ledger itself ends the stream.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        ledger = Ledger(session, ledger_folder)
        found = {run_key(r.path): r for r in batch.select("path", "length").distinct().collect()}
        finished = ledger.runs().filter(F.col("status").isin("AWAITING_REVIEW", "TRANSFORMING", "COMPLETED", "FAILED"))
        offered = F.broadcast(session.createDataFrame([(k,) for k in found], "file_id string"))
        for r in finished.join(offered, "file_id", "left_semi").select("file_id").distinct().collect():
            del found[r.file_id]
        limit = block_size(session)
        small = {r.path: k for k, r in found.items() if r.length <= limit and multi_line}
        alone = {k: r.path for k, r in found.items() if r.path not in small}
        if small:
            try:
                analyse_files(session, ledger, small, f"{run_key(checkpoint)} {batch_id}", user_id, has_header, flags)
            except Exception:
                # one of them breaks the common jobs: each by itself, so that only that one fails
                logging.getLogger(__name__).warning("batch %s is analysed file by file", batch_id, exc_info=True)
                alone |= {k: p for p, k in small.items()}
        for key, path in alone.items():
            _one(session, ledger, path, key, user_id, has_header, flags, multi_line)

    return (
        arrivals(spark, folder).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _one(spark: SparkSession, ledger: Ledger, path: str, key: str, user_id: str, has_header: bool, flags: bool, multi_line: bool) -> None:
    run_id = uuid.uuid4().hex
    try:
        analyse_file(spark, ledger, path, user_id, has_header, file_id=key, run_id=run_id, flags=flags, multi_line=multi_line)
    except Exception:
        # a failure that is in the ledger is a result; one that is not must not get lost
        if not ledger.runs().where((F.col("run_id") == run_id) & (F.col("status") == "FAILED")).count():
            raise
