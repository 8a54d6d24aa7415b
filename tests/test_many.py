"""Many files by one set of jobs against each file by itself."""

import json
import math
import random
from dataclasses import asdict

import pytest

from limpid.operators.impact import Strategies, drop_flags, drop_impact, patterns_of_flags, strategies_of
from limpid.operators.many import profile_files
from limpid.operators.profile import profile_table
from limpid.plans.rules import build_plan
from limpid.run import analyse_file, analyse_files, impact_of_run
from limpid.sources import ledger as L
from limpid.sources.csv import read_csv
from limpid.streaming.arrivals import analyse_arrivals


def write_file(rng, path, rows, columns):
    def cell(name, i):
        return {
            "id": lambda: str(i), "amt": lambda: "" if i % 7 == 0 else "-99999" if i % 11 == 0 else str(round(rng.random() * 100, 2)),
            "st": lambda: rng.choice(["a", "b", "N/A ", "unknown", "", '"q, ""x"""']), "fl": lambda: rng.choice(["True", "false", ""]),
            "yes": lambda: rng.choice(["TRUE", "False"]), "mix": lambda: rng.choice(["1", "2", "$3", "x4", "5", "6.5"]),
            "dt": lambda: rng.choice(["2024-01-02", "2023/5/6", "2020-02-03", "nope" if i % 9 == 0 else "1999-12-31"]),
            "tx": lambda: '"' + "long\ntext " * 20 + str(i % 3) + '"', "e": lambda: "", "num": lambda: rng.choice(["1", "1.0", " 2", "1e5"])}[name]()

    lines = [",".join(cell(c, i) for c in columns) for i in range(rows)]
    lines += lines[:3] + ([",".join("x" * (len(columns) + 2))] if rows else [])
    path.write_text("\n".join([",".join(columns), *lines]) + "\n")


def close(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("landed"), random.Random(5)
    write_file(rng, folder / "a.csv", 200, ["id", "amt", "st", "fl", "mix", "dt", "tx", "e"])
    write_file(rng, folder / "b.csv", 45, ["amt", "yes", "dt", "num"])
    write_file(rng, folder / "c.csv", 4, ["id", "st", "id"])
    (folder / "odd name ü.csv").write_text("x,y\n1,2\n")
    write_file(rng, folder / "d.csv", 0, ["id", "st"])
    (folder / "broken.csv").write_text("\n\n")
    return folder


def test_same_profiles_plans_and_flags(spark, landed):
    paths = [str(landed / f"{n}.csv") for n in "abcd"]
    found = profile_files(spark, [*paths, str(landed / "broken.csv")])
    assert list(found.failures) == [f"file:{landed}/broken.csv"]
    plans, wanted = {}, {}
    for path in paths:
        table = read_csv(spark, path)
        want, got = profile_table(table.df, table.malformed_rows, missingness=True), found.profiles[f"file:{path}"]
        assert close(asdict(got), asdict(want)), path
        plans[f"file:{path}"] = plan = build_plan(got)
        same, other = (asdict(x) for x in (plan, build_plan(want)))
        assert close(same | {"metadata": 0}, other | {"metadata": 0})
        wanted[path[-5]] = patterns_of_flags(drop_flags(table.df, plan))
    masks = found.flag_masks(plans, {p: p[-5] for p in plans}).cache()
    from limpid.operators.masks import impact_of_masks

    for path, plan in plans.items():
        own = masks.where(f"key = '{path[-5]}'").drop("key")
        for chosen in (strategies_of(plan), Strategies({c: "drop_row" for c in plan.columns}, {c: "remove" for c in plan.outliers}, "drop")):
            assert impact_of_masks(own, chosen).collect() == drop_impact(wanted[path[-5]], chosen).collect()


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs_for(n):
        folder = tmp_path / f"n{n}"
        folder.mkdir()
        rng = random.Random(n)
        for k in range(n):
            write_file(rng, folder / f"{k:03}.csv", 20 + k % 5, ["id", "amt", "st", "dt"][: 2 + k % 3])
        group = f"files {n}"
        spark.sparkContext.setJobGroup(group, group)
        found = profile_files(spark, [str(folder)])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(found.profiles) == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs_for(5), jobs_for(120)
    # Spark lists many input paths by one job of its own
    assert many <= few + 5


def test_one_commit_for_a_batch(spark, landed, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path))
    paths = {str(p): p.stem for p in sorted(landed.iterdir())}
    states = analyse_files(spark, ledger, paths, "batch 7", "ann")
    assert states == {"a": "AWAITING_REVIEW", "b": "AWAITING_REVIEW", "c": "AWAITING_REVIEW", "d": "AWAITING_REVIEW", "broken": "FAILED",
                      "odd name ü": "AWAITING_REVIEW"}
    analyse_files(spark, ledger, paths, "batch 7", "ann")
    assert ledger.log.snapshot()[0] == 1 and ledger.runs().count() == 6 and ledger.files().count() == 6
    run = ledger.runs().where("file_id = 'a'").first()
    assert json.loads(run.scores_before)["malformed_rows"] == 1 and "outliers" in run.plan_generated and run.completed_at is None
    alone = analyse_file(spark, ledger, str(landed / "a.csv"), file_id="alone")
    chosen = Strategies({"st": "drop_row", "e": "drop_row"}, {"amt": "remove"}, "drop")
    assert impact_of_run(spark, ledger, run.run_id, chosen).collect() == impact_of_run(spark, ledger, alone, chosen).collect()
    assert "no columns" in ledger.runs().where("file_id = 'broken'").first().error_message


def test_missing_flags_are_no_failure(spark, landed, tmp_path, monkeypatch):
    import limpid.run

    def fail(*_):
        raise OSError("no space")

    monkeypatch.setattr(limpid.run, "drop_flags", fail)
    ledger = L.Ledger(spark, str(tmp_path))
    run = ledger.run(analyse_file(spark, ledger, str(landed / "b.csv")))
    assert run["status"] == "AWAITING_REVIEW" and run["flags_path"] is None
    with pytest.raises(LookupError):
        impact_of_run(spark, ledger, run["run_id"], Strategies({}, {}))


def test_ledger_errors_end_the_stream(spark, tmp_path, monkeypatch):
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.csv").write_text("x\n1\n")

    def fail(*_, **__):
        raise OSError("ledger is read-only")

    monkeypatch.setattr(L.Ledger, "commit_once", fail)
    monkeypatch.setattr(L.Ledger, "add_file", fail)
    with pytest.raises(Exception, match="read-only"):
        analyse_arrivals(spark, str(tmp_path / "landing"), str(tmp_path / "books"), str(tmp_path / "checkpoint")).awaitTermination()
