"""Entry points: analyse a table, apply a plan, and both with a ledger."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.operators.apply import Applied, apply_plan, observed, observed_rows, written_change_report
from limpid.operators.impact import Strategies, drop_flags, drop_impact, patterns_of_flags
from limpid.operators.many import address_of, profile_files
from limpid.operators.masks import impact_of_masks
from limpid.operators.profile import TableProfile, profile_table
from limpid.operators.score import score_report
from limpid.plans.model import Plan
from limpid.plans.rules import build_plan
from limpid.session import stage
from limpid.sources.csv import preview_csv, read_csv
from limpid.sources.ledger import Ledger, file_event, run_event
from limpid.sources.tables import ROW_ID, data_columns, write_cleaned


@dataclass
class Analysis:
    profile: TableProfile
    scores: dict
    plan: Plan


def analyse(df: DataFrame, malformed_rows: int = 0, row_id: str | None = ROW_ID, lasting: str | None = None) -> Analysis:
    """Profile, score and plan of a table; ``lasting`` is a folder for what the plan refers to."""
    profile = profile_table(df, malformed_rows, row_id, missingness=True, lasting=lasting)
    return Analysis(profile, score_report(profile), build_plan(profile))


@dataclass
class Cleaned:
    """A written table; ``changes`` is its row of ``change_report``."""

    applied: Applied
    path: str | None
    scores: dict
    changes: DataFrame | None = None


def clean(df: DataFrame, plan: Plan, zone: str | None = None, file_id: str = "table", run_id: str = "run",
          row_id: str | None = ROW_ID) -> Cleaned:
    """Apply a plan, write the cleaned table, and score it.

    The result is staged once as parquet; the CSV sink and the second profile both read that. Rows
    before and after are counted by the passes that read and write them anyway.
    """
    source, before = observed(df)
    applied = apply_plan(source, plan, row_id)
    result, after = observed(applied.df)
    applied.df = stage(result, "cleaned")
    changes = written_change_report(
        df.sparkSession, observed_rows(before, df), observed_rows(after, applied.df), data_columns(df, row_id), data_columns(applied.df, row_id))
    path = write_cleaned(applied.df, zone, file_id, run_id) if zone else None
    profile = profile_table(applied.df, row_id=row_id)
    return Cleaned(applied, path, score_report(profile, {n: asdict(o) for n, o in plan.outliers.items()}), changes)


def analyse_file(spark: SparkSession, ledger: Ledger, path: str, user_id: str = "", has_header: bool = True,
                 file_id: str | None = None, run_id: str | None = None, flags: bool = True, multi_line: bool = True) -> str:
    """Analysis of one file with its trail in the ledger; returns the run id.

    Failure of the analysis is recorded and raised. Missing drop flags are not a failure.
    """
    file_id = ledger.add_file(user_id, path.rsplit("/", 1)[-1], path, has_header=has_header, file_id=file_id)
    run_id = ledger.start_run(file_id, run_id)
    ledger.advance(run_id, "ANALYZING")
    try:
        table = read_csv(spark, path, has_header, multi_line)
        found = analyse(table.df, table.malformed_rows, lasting=f"{ledger.folder}/sentinels/{run_id}")
        # a lasting result, so it lies beside the ledger that names it and not in the scratch folder
        flags_path = _written_flags(lambda: drop_flags(table.df, found.plan), f"{ledger.folder}/flags/{run_id}") if flags else None
        ledger.advance(run_id, "AWAITING_REVIEW", scores_before=json.dumps(found.scores),
                       plan_generated=found.plan.to_json(), flags_path=flags_path)
    except Exception as e:
        ledger.advance(run_id, "FAILED", error_message=str(e))
        raise
    return run_id


def _written_flags(flags: Callable[[], DataFrame], path: str, by: str | None = None) -> str | None:
    """The folder that drop flags were written to; None, with a note in the log, if they could not be."""
    try:
        writer = flags().write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return path
    except Exception:
        logging.getLogger(__name__).warning("no drop flags in %s", path, exc_info=True)
        return None


def analyse_files(spark: SparkSession, ledger: Ledger, paths: dict[str, str], key: str, user_id: str = "",
                  has_header: bool = True, flags: bool = True) -> dict[str, str]:
    """Analysis of many small files, path -> file id, by one set of jobs and one commit; returns file id -> status.

    The commit has a key, so a batch that runs again after a crash leaves one trail. Drop flags
    of all files are written by one job, as bitmaps in a folder per run. A file that cannot
    be analysed ends as FAILED.
    """
    address = {p: address_of(spark, p) for p in paths}
    ids = {address[p]: i for p, i in paths.items()}
    runs = {p: hashlib.sha256(f"{key} {i}".encode()).hexdigest()[:32] for p, i in ids.items()}
    begun = [run_event(runs[address[p]], i, status) for p, i in paths.items() for status in ("PENDING", "ANALYZING")]
    started = {"created_at": begun[0]["created_at"]} if begun else {}
    found = profile_files(spark, list(paths), has_header, f"{ledger.folder}/sentinels")
    done = {p: Analysis(t, score_report(t), build_plan(t)) for p, t in found.profiles.items()}
    folder = None
    if flags and done:
        plans, path = {p: a.plan for p, a in done.items()}, f"{ledger.folder}/flags/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
        folder = _written_flags(lambda: found.flag_masks(plans, {p: runs[p] for p in done}), path, "key")
    events, states = begun, {}
    for given, path in address.items():
        file_id, run_id = ids[path], runs[path]
        if path in done:
            last = run_event(run_id, file_id, "AWAITING_REVIEW", scores_before=json.dumps(done[path].scores),
                             plan_generated=done[path].plan.to_json(), flags_path=f"{folder}/key={run_id}" if folder else None)
        else:
            last = run_event(run_id, file_id, "FAILED", error_message=found.failures.get(path, f"no file {path}"))
        last, states[file_id] = last | started, last["status"]
        events += [file_event(file_id, user_id, given.rsplit("/", 1)[-1], given, has_header=has_header), last]
    ledger.commit_once(key, events)
    return states


def impact_of_run(spark: SparkSession, ledger: Ledger, run_id: str, chosen: Strategies) -> DataFrame:
    """How many rows a choice of strategies drops, from the flags a run has stored; the table is not read again."""
    path = ledger.run(run_id)["flags_path"]
    if not path:
        raise LookupError(f"run {run_id} has no drop flags")
    stored = spark.read.parquet(path)
    return impact_of_masks(stored, chosen) if "mask" in stored.columns else drop_impact(patterns_of_flags(stored), chosen)


def clean_file(spark: SparkSession, ledger: Ledger, run_id: str, zone: str, approved: Plan | None = None,
               multi_line: bool = True) -> Cleaned:
    """Apply the approved plan of a reviewed run and close the run."""
    run = ledger.run(run_id)
    plan = approved or Plan.from_json(run["plan_generated"])
    ledger.advance(run_id, "TRANSFORMING", plan_approved=plan.to_json())
    try:
        source = ledger.files().filter(F.col("file_id") == run["file_id"]).first()
        table = read_csv(spark, source.raw_path, source.has_header, multi_line)
        done = clean(table.df, ledger.approved_plan(run_id), zone, run["file_id"], run_id)
        ledger.advance(run_id, "COMPLETED", scores_after=json.dumps(done.scores), curated_path=done.path)
    except Exception as e:
        ledger.advance(run_id, "FAILED", error_message=str(e))
        raise
    return done


def preview_run(spark: SparkSession, ledger: Ledger, run_id: str, part: str = "raw", multi_line: bool = True) -> DataFrame:
    """First rows of a run's source (``raw``) or, once it is completed, of its result (``cleaned``)."""
    run = ledger.run(run_id)
    if part == "cleaned":
        if run["status"] != "COMPLETED" or not run["curated_path"]:
            raise ValueError("the cleaned table is not available yet")
        return preview_csv(spark, run["curated_path"])
    if part != "raw":
        raise ValueError(f"part must be 'raw' or 'cleaned', not {part!r}")
    source = ledger.files().filter(F.col("file_id") == run["file_id"]).first()
    return preview_csv(spark, source.raw_path, source.has_header, multi_line=multi_line)
