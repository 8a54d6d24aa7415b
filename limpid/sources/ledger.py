"""The ledger of files and runs as tables, and the questions asked of it.

Runs are append-only status events: (run_id, file_id, status, created_at, at, ...). The state of a
run is its latest event, so writers only append and never rewrite history. They append to one log of
numbered commits (``commits``), where a number goes to one writer only.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limpid.functions.constants import RESULT_DAYS, RUN_STATUSES, SOURCE_DAYS
from limpid.plans.model import Plan
from limpid.sources.commits import CommitLog

FILE_SCHEMA = (
    "file_id string, user_id string, original_filename string, file_size long, has_header boolean, "
    "raw_path string, uploaded_at timestamp"
)
RUN_SCHEMA = (
    "run_id string, file_id string, status string, created_at timestamp, at timestamp, "
    "completed_at timestamp, scores_before string, scores_after string, plan_generated string, "
    "plan_approved string, curated_path string, flags_path string, error_message string"
)
FINAL = ("COMPLETED", "FAILED")
# Transitions of the run status.
NEXT_STATUS = {
    None: ("PENDING", "AWAITING_REVIEW"),
    "PENDING": ("ANALYZING", "FAILED"),
    "ANALYZING": ("AWAITING_REVIEW", "FAILED"),
    "AWAITING_REVIEW": ("TRANSFORMING", "FAILED"),
    "TRANSFORMING": ("COMPLETED", "FAILED"),
}


def check_page(skip: int, limit: int) -> None:
    if skip < 0 or not 1 <= limit <= 200:
        raise ValueError("skip must be >= 0 and limit between 1 and 200")


def files_of_user(files: DataFrame, user_id, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of a user's files, newest first."""
    check_page(skip, limit)
    return (files.filter(F.col("user_id") == user_id)
            .orderBy(F.desc("uploaded_at"), "file_id").offset(skip).limit(limit))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of every file; every task keeps one candidate per file before the shuffle."""
    newest = Window.partitionBy("file_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= 1).drop("__rank")


def latest_run_of(runs: DataFrame, file_id) -> DataFrame:
    return runs.filter(F.col("file_id") == file_id).orderBy(F.desc("created_at"), F.desc("run_id")).limit(1)


def runs_of_file(runs: DataFrame, file_id) -> DataFrame:
    return runs.filter(F.col("file_id") == file_id).orderBy(F.desc("created_at"), F.desc("run_id"))


def files_with_latest_run(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Every file with its newest run; files without runs stay, with nulls."""
    newest = latest_run(runs).select(
        "file_id", "run_id", F.col("status").alias("run_status"), F.col("created_at").alias("run_created_at"))
    return files.join(newest, "file_id", "left")


def page_with_latest_run(files: DataFrame, runs: DataFrame, user_id, skip: int = 0, limit: int = 50) -> DataFrame:
    """One page of files with their newest runs: the page is cut first, so only its runs are ranked."""
    page = files_of_user(files, user_id, skip, limit)
    # at most 200 files
    wanted = runs.join(F.broadcast(page.select("file_id")), "file_id", "left_semi")
    return files_with_latest_run(page, wanted).orderBy(F.desc("uploaded_at"), "file_id")


def owned_runs(runs: DataFrame, files: DataFrame, user_id, run_id=None) -> DataFrame:
    """Runs of files that belong to a user. Spark picks the join; the file side is filtered first."""
    mine = files.filter(F.col("user_id") == user_id).select("file_id")
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    return runs.join(mine, "file_id")


def run_state(events: DataFrame) -> DataFrame:
    """Current state per run: latest event, completion time set by the first final status."""
    # events of one instant follow the order in which a run goes through its statuses
    stages = F.array(*[F.lit(s) for s in (*(k for k in NEXT_STATUS if k), *FINAL)])
    newest = Window.partitionBy("run_id").orderBy(F.desc("at"), F.desc(F.array_position(stages, F.col("status"))))
    last = events.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= 1).drop("__rank")
    done = completion_time(F.col("status"), F.col("at"), F.col("completed_at"))
    return last.withColumn("completed_at", done)


def completion_time(status: Column, at: Column, earlier: Column) -> Column:
    """Completion is stamped when a run ends and left alone otherwise."""
    return F.when(status.isin(*FINAL), at).otherwise(earlier)


def expiry_flags(runs: DataFrame, now: Column) -> DataFrame:
    """Source data expires after 7 days, the result of a completed run after 14."""
    created = F.col("created_at")
    return runs.withColumns({
        "source_expired": created < now - F.expr(f"INTERVAL {SOURCE_DAYS} DAYS"),
        "result_expired": (F.col("status") == "COMPLETED") & (created < now - F.expr(f"INTERVAL {RESULT_DAYS} DAYS")),
    })


def recency_bucket(created: Column, now: Column) -> Column:
    day, today = created.cast("date"), now.cast("date")
    return (F.when(day >= today, "Today").when(day >= F.date_sub(today, 1), "Yesterday")
            .when(day >= F.date_sub(today, 7), "Last 7 days").otherwise("Older"))


def recency_groups(runs: DataFrame, now: Column) -> DataFrame:
    """Runs per recency group; empty groups do not appear.

    A group of any size is only counted here; its members are rows of :func:`recency_members`.
    """
    return (runs.groupBy(recency_bucket(F.col("created_at"), now).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("runs"), F.max("created_at").alias("newest")))


def recency_members(runs: DataFrame, now: Column) -> DataFrame:
    """Runs with their recency group as ``bucket``."""
    return runs.withColumn("bucket", recency_bucket(F.col("created_at"), now))


# One event of the log: a file or a status of a run.
LOG_SCHEMA = f"kind string, commit_key string, {RUN_SCHEMA}, {FILE_SCHEMA.replace('file_id string, ', '')}"
_FILE_FIELDS = [f.split()[0] for f in FILE_SCHEMA.split(", ")]
_RUN_FIELDS = [f.split()[0] for f in RUN_SCHEMA.split(", ")]


class Ledger:
    """Files and runs as events of one commit log in a folder.

    A status changes by a conditional commit: the transition is judged over the newest events, and
    again if another writer commits first. So of two writers that would take a run from one status to the next,
    one does and the other is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, self.folder, LOG_SCHEMA)

    def files(self) -> DataFrame:
        """One row per file; a file registered again after a crash keeps its newest entry."""
        newest = Window.partitionBy("file_id").orderBy(F.desc("uploaded_at"), "raw_path")
        found = self.log.snapshot()[1].where("kind = 'file'").select(*_FILE_FIELDS)
        ranked = found.withColumn("__rank", F.row_number().over(newest))
        return ranked.filter(F.col("__rank") <= 1).drop("__rank")

    def events(self) -> DataFrame:
        return self._run_events(self.log.snapshot()[1])

    @staticmethod
    def _run_events(log: DataFrame) -> DataFrame:
        return log.where("kind = 'run'").select(*_RUN_FIELDS)

    def runs(self) -> DataFrame:
        return run_state(self.events())

    def add_file(self, user_id: str, filename: str, raw_path: str, size: int = 0, has_header: bool = True,
                 file_id: str | None = None) -> str:
        event = file_event(file_id or str(uuid.uuid4()), user_id, filename, raw_path, size, has_header)
        self.log.append([event])
        return event["file_id"]

    def start_run(self, file_id: str, run_id: str | None = None, status: str = "PENDING", **values) -> str:
        event = run_event(run_id or str(uuid.uuid4()), file_id, status, **values)
        self.log.append([event])
        return event["run_id"]

    def run(self, run_id: str) -> dict:
        return self._state(self.log.snapshot()[1], run_id)

    def _state(self, log: DataFrame, run_id: str) -> dict:
        row = run_state(self._run_events(log).filter(F.col("run_id") == run_id)).first()
        if row is None:
            raise LookupError(f"no run {run_id}")
        return row.asDict()

    def advance(self, run_id: str, status: str, **values) -> None:
        """Commit the next status of a run; the transition must be a legal one from what the run is by then."""
        if status not in RUN_STATUSES:
            raise ValueError(f"unknown status {status!r}")

        def following(log: DataFrame) -> list[dict]:
            current = self._state(log, run_id)
            if status not in NEXT_STATUS.get(current["status"], ()):
                raise ValueError(f"a run cannot go from {current['status']} to {status}")
            now = _now()
            done = now if status in FINAL else current["completed_at"]
            return [{"kind": "run"} | current | values | {"status": status, "at": now, "completed_at": done}]

        self.log.append(following)

    def commit_once(self, key: str, events: list[dict]) -> bool:
        """Commit events under a key, unless the log has events under it: safe to repeat after a crash."""
        def unless_done(log: DataFrame) -> list[dict]:
            return [] if log.where(F.col("commit_key") == key).limit(1).count() else [e | {"commit_key": key} for e in events]

        return bool(self.log.append(unless_done))

    def approved_plan(self, run_id: str) -> Plan:
        """The plan a run was approved with; an error if there is none."""
        text = self.run(run_id)["plan_approved"]
        if not text:
            raise LookupError(f"run {run_id} has no approved plan")
        return Plan.from_json(text)

    def restart(self, run_id: str) -> str:
        """Clone a finished run for another review: its plan, first scores and drop flags carry over."""
        source = self.run(run_id)
        if source["status"] not in FINAL:
            raise ValueError(f"only a COMPLETED or FAILED run can be restarted, not {source['status']}")
        if not source["plan_generated"]:
            raise ValueError("the analysis did not complete: there is no plan to copy")
        return self.start_run(
            source["file_id"], status="AWAITING_REVIEW", scores_before=source["scores_before"],
            plan_generated=carried_plan(source["plan_generated"], source["plan_approved"]),
            flags_path=source["flags_path"])


def file_event(file_id: str, user_id: str, filename: str, raw_path: str, size: int = 0, has_header: bool = True) -> dict:
    return {"kind": "file", "file_id": file_id, "user_id": user_id, "original_filename": filename, "file_size": size,
            "has_header": has_header, "raw_path": raw_path, "uploaded_at": _now()}


def run_event(run_id: str, file_id: str, status: str, **values) -> dict:
    now = _now()
    ended = {"completed_at": now} if status in FINAL else {}
    return {"kind": "run", "run_id": run_id, "file_id": file_id, "status": status, "created_at": now, "at": now} | ended | values


def carried_plan(generated: str, approved: str | None) -> str:
    """The approved plan if there is one, with the report section of the generated plan."""
    if not approved:
        return generated
    plan, first = Plan.from_json(approved), Plan.from_json(generated)
    if plan.eda is None:
        plan.eda = first.eda
    return plan.to_json()


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)
