"""Numbered commits, conditional status changes and compaction."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from limpid.sources import commits
from limpid.sources.commits import CommitLog
from limpid.sources.ledger import Ledger, file_event, run_event

SCHEMA = "who string, n long, at timestamp"


def test_a_number_goes_to_one_writer(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path), SCHEMA)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: log.put(1, [{"who": f"w{k}", "n": k}]), range(16)))
    assert sum(won) == 1
    last, events = log.snapshot()
    assert last == 1 and [r.n for r in events.collect()] == [won.index(True)]
    assert log._names("prepared") == [] and len(log._names("log", f"{1:020}")) == 1


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "COMPACT_EVERY", 4)
    logs = [CommitLog(spark, str(tmp_path), SCHEMA) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: logs[k % 4].append([{"who": "x", "n": k}]), range(16)))
    last, events = logs[0].snapshot()
    assert last == 16 and sorted(r.n for r in events.collect()) == list(range(16))


def test_compaction_and_a_writer_that_slept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "COMPACT_EVERY", 3)
    log = CommitLog(spark, str(tmp_path), SCHEMA)
    for k in range(10):
        log.append([{"n": k}])
    assert log._names("log") == [f"{n:020}" for n in range(7, 11)] and len(log._tables()) == 2
    assert sorted(r.n for r in log.snapshot()[1].collect()) == list(range(10))
    # number 2 is cleared away; who still believes it to be free must not get it
    assert log.put(2, [{"n": 99}]) is False
    assert log.append([{"n": 10}]) == [{"n": 10}]
    assert sorted(r.n for r in log.snapshot()[1].collect()) == list(range(11))


def test_two_approvals_of_one_run(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    run_id = ledger.start_run("f", status="AWAITING_REVIEW")

    def approve(k):
        try:
            Ledger(spark, str(tmp_path)).advance(run_id, "TRANSFORMING", plan_approved=f"plan {k}")
            return k
        except ValueError as e:
            assert "from TRANSFORMING to TRANSFORMING" in str(e)

    with ThreadPoolExecutor(4) as pool:
        winners = [k for k in pool.map(approve, range(4)) if k is not None]
    assert len(winners) == 1 and ledger.run(run_id)["plan_approved"] == f"plan {winners[0]}"


def test_many_runs_in_few_files(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    for part in range(4):
        ledger.log.append([e for k in range(2500) for e in (
            file_event(f"f{part}-{k}", "ann", "a.csv", "p"), run_event(f"r{part}-{k}", f"f{part}-{k}", "PENDING"))])
    ledger.log.compact()
    ledger.advance("r1-17", "ANALYZING")
    runs = ledger.runs()
    assert runs.count() == 10_000 and runs.where("status = 'ANALYZING'").count() == 1 and ledger.files().count() == 10_000
    assert len(ledger.events().inputFiles()) == 2


def test_commit_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    events = [run_event("r", "f", "FAILED", error_message='line one\nline "two"')]
    assert ledger.commit_once("batch 1", events) and not ledger.commit_once("batch 1", events)
    run = ledger.run("r")
    assert ledger.events().count() == 1 and run["error_message"] == 'line one\nline "two"' and run["completed_at"] is not None
    with pytest.raises(LookupError):
        ledger.run("other")
    assert Ledger(spark, str(tmp_path / "new")).runs().count() == 0
