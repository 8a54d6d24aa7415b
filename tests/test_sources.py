import json

import pytest
from pyspark.sql import functions as F

from limpid.operators.apply import apply_plan
from limpid.plans.model import Plan
from limpid.run import analyse_file, clean_file, preview_run
from limpid.sources import ledger as L
from limpid.sources.csv import preview_csv, read_csv, unique_names
from limpid.sources.tables import ROW_ID, preview, read_parquet, write_cleaned
from limpid.streaming.arrivals import analyse_arrivals


def parse(spark, tmp_path, text, **kw):
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode())
    table = read_csv(spark, str(path), **kw)
    return [tuple(r)[1:] for r in table.df.orderBy(ROW_ID).collect()], dict(table.df.dtypes), table.malformed_rows


def test_plain(spark, tmp_path):
    rows, kinds, bad = parse(spark, tmp_path, "a,b,c\n1,x,2.5\n2,y,\n")
    assert rows == [(1, "x", 2.5), (2, "y", None)] and bad == 0
    assert [kinds[c] for c in "abc"] == ["bigint", "string", "double"]


def test_long_records_are_malformed_and_short_ones_padded(spark, tmp_path):
    text = 'a,b,c\n1,2,3\n4,5,6,7\n8,9\n"x,y",10,11\n12,13,14,\n"p,q",1,2,3\n"say ""hi"", you",1,2\n'
    rows, _, bad = parse(spark, tmp_path, text)
    assert bad == 3
    assert rows == [("1", 2, 3.0), ("8", 9, None), ("x,y", 10, 11.0), ('say "hi", you', 1, 2.0)]


def test_null_tokens_and_storage(spark, tmp_path):
    text = ("i,f,b,g,t,e,d\n1,1,True,True,x,,2024-01-01\n2,NA,FALSE,n/a,unknown,NaN,2024-01-02\n3,2,true,False,-,null,x\n"
            "4, 5 ,false,None, n/a,,y\n")
    rows, kinds, _ = parse(spark, tmp_path, text)
    assert [kinds[c] for c in "ifbgted"] == ["bigint", "double", "boolean", "boolean", "string", "double", "string"]
    assert [r[4] for r in rows] == ["x", "unknown", "-", " n/a"] and [r[1] for r in rows] == [1.0, None, 2.0, 5.0]


def test_header_only_and_crlf_and_blank_lines(spark, tmp_path):
    rows, kinds, bad = parse(spark, tmp_path, "a,b\n")
    assert rows == [] and bad == 0 and kinds["a"] == "string"
    rows, _, _ = parse(spark, tmp_path, "a,b\r\n1,x\r\n\r\n2,y\r\n")
    assert rows == [(1, "x"), (2, "y")]


def test_headerless_and_repeated_names(spark, tmp_path):
    rows, kinds, _ = parse(spark, tmp_path, "1,x\n2,y\n", has_header=False)
    assert rows == [(1, "x"), (2, "y")] and set(kinds) == {ROW_ID, "col_0", "col_1"}
    assert unique_names(["a", "a", "", "a"]) == ["a", "a.1", "Unnamed: 2", "a.2"]
    rows, kinds, _ = parse(spark, tmp_path, "a,a\n1,x\n")
    assert rows == [(1, "x")] and "a.1" in kinds


def test_empty_file(spark, tmp_path):
    with pytest.raises(ValueError):
        parse(spark, tmp_path, "")


def test_row_ids_follow_the_file_however_it_is_split(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("n\n" + "".join(f"{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = read_csv(spark, str(path)).df
        assert [r.n for r in df.orderBy(ROW_ID).collect()] == list(range(20_000))
        assert df.select(ROW_ID).distinct().count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_ids_of_many_files(spark, tmp_path, monkeypatch):
    from limpid.sources import tables

    path = str(tmp_path / "t")
    spark.range(1000).repartition(6).write.parquet(path)
    few = {r.id: r[ROW_ID] for r in read_parquet(spark, path).collect()}
    monkeypatch.setattr(tables, "_MAP_FILES", 1)
    joined = {r.id: r[ROW_ID] for r in read_parquet(spark, path).collect()}
    assert few == joined and len(set(few.values())) == 1000 and None not in few.values()


def test_cleaned_sink_and_preview(spark, tmp_path, frame):
    df = frame(a=list(range(30)), s=["" if i == 3 else ' q"x", ' if i == 1 else None if i == 2 else "v" for i in range(30)])
    path = write_cleaned(apply_plan(df, Plan()).df, str(tmp_path), "f", "r")
    assert path.endswith("f/r/cleaned")
    back = {r.a: r.s for r in read_csv(spark, path).df.collect()}
    assert back[1] == 'q"x",' and back[2] is None and len(back) == 30
    first = preview(df)
    assert [r.a for r in first.collect()] == list(range(20)) and ROW_ID not in first.columns


def test_ledger_life_of_a_run(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("k,v,s\n" + "".join(f"{i},{'' if i % 9 == 0 else i},{'ab'[i % 2]}\n" for i in range(60)) + "1,2,3,4\n")
    ledger = L.Ledger(spark, str(tmp_path / "ledger"))
    run_id = analyse_file(spark, ledger, str(source), "ann")
    run = ledger.run(run_id)
    scores = json.loads(run["scores_before"])
    assert run["status"] == "AWAITING_REVIEW" and scores["malformed_rows"] == 1 and scores["total_rows"] == 60
    assert run["completed_at"] is None and spark.read.parquet(run["flags_path"]).count() == 60
    with pytest.raises(ValueError):
        ledger.restart(run_id)
    with pytest.raises(LookupError):
        ledger.approved_plan(run_id)
    with pytest.raises(ValueError):
        preview_run(spark, ledger, run_id, "cleaned")
    raw = preview_run(spark, ledger, run_id).collect()
    assert [r.k for r in raw] == list(range(20)) and raw[0].v is None and raw[1].v == 1.0
    done = clean_file(spark, ledger, run_id, str(tmp_path / "curated"))
    assert preview_run(spark, ledger, run_id, "cleaned").count() <= 20
    run = ledger.run(run_id)
    assert run["status"] == "COMPLETED" and run["completed_at"] is not None and run["curated_path"] == done.path
    assert json.loads(run["scores_after"])["completeness"] == 100.0
    with pytest.raises(ValueError):
        ledger.advance(run_id, "ANALYZING")
    again = ledger.run(ledger.restart(run_id))
    assert again["status"] == "AWAITING_REVIEW" and again["flags_path"] == run["flags_path"]
    assert Plan.from_json(again["plan_generated"]) == ledger.approved_plan(run_id)
    page = L.page_with_latest_run(ledger.files(), ledger.runs(), "ann").collect()
    assert [(r.run_id, r.run_status) for r in page] == [(again["run_id"], "AWAITING_REVIEW")]
    assert L.owned_runs(ledger.runs(), ledger.files(), "bob").count() == 0


def test_failed_run(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("")
    ledger = L.Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(ValueError):
        analyse_file(spark, ledger, str(tmp_path / "bad.csv"))
    run = ledger.runs().first()
    assert run.status == "FAILED" and "no columns" in run.error_message and run.completed_at is not None


def test_restart_restores_the_report_section():
    generated = Plan(eda={"total_rows": 3})
    approved = Plan(metadata={"by": "ann"})
    carried = Plan.from_json(L.carried_plan(generated.to_json(), approved.to_json()))
    assert carried.eda == {"total_rows": 3} and carried.metadata == {"by": "ann"}
    assert L.carried_plan(generated.to_json(), None) == generated.to_json()


def test_paging_limits(spark):
    files = spark.createDataFrame([], L.FILE_SCHEMA)
    for skip, limit in ((-1, 5), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            L.files_of_user(files, "u", skip, limit)


def test_recency(spark):
    rows = [(d,) for d in ("2024-05-10 01:00", "2024-05-10 23:00", "2024-05-09 23:59", "2024-05-03 00:00", "2024-05-02 23:59")]
    runs = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias("created_at"))
    got = {r.bucket: r.runs for r in L.recency_groups(runs, F.lit("2024-05-10 12:00").cast("timestamp")).collect()}
    assert got == {"Today": 2, "Yesterday": 1, "Last 7 days": 1, "Older": 1}


def test_arrivals_are_analysed_once(spark, tmp_path):
    landing, books, checkpoint = (str(tmp_path / n) for n in ("landing", "books", "checkpoint"))
    (tmp_path / "landing").mkdir()
    for name, rows in (("a", 12), ("b", 15)):
        (tmp_path / "landing" / f"{name}.csv").write_text("x,y\n" + "".join(f"{i},{i % 3}\n" for i in range(rows)))
    (tmp_path / "landing" / "broken.csv").write_text("\n\n")
    (tmp_path / "landing" / "other.txt").write_text("x\n1\n")
    analyse_arrivals(spark, landing, books, checkpoint).awaitTermination()
    ledger = L.Ledger(spark, books)
    state = sorted((r.status, json.loads(r.scores_before)["total_rows"] if r.scores_before else 0) for r in ledger.runs().collect())
    assert state == [("AWAITING_REVIEW", 12), ("AWAITING_REVIEW", 15), ("FAILED", 0)]
    (tmp_path / "landing" / "c.csv").write_text("x\n1\n2\n")
    analyse_arrivals(spark, landing, books, checkpoint).awaitTermination()
    # a new checkpoint offers all files again; those with a result are left alone
    analyse_arrivals(spark, landing, books, checkpoint + "-2").awaitTermination()
    assert ledger.runs().count() == 4 and ledger.files().count() == 4


def test_long_cells_and_line_breaks(spark, tmp_path):
    long = "x,\n" * 250_000
    text = 'id,a,b\n1,"' + long + '",2\n2,"' + long + '"\n3,"' + long + '",4,5\n4,"line one\nline ""two""",6\n'
    (tmp_path / "in.csv").write_text(text)
    table = read_csv(spark, str(tmp_path / "in.csv"))
    rows = {r.id: r for r in table.df.collect()}
    assert table.malformed_rows == 1 and sorted(rows) == [1, 2, 4]
    assert len(rows[1].a) == len(long.rstrip("\n")) or rows[1].a == long
    assert rows[2].b is None and rows[4].a == 'line one\nline "two"' and rows[4].b == 6


def test_header_of_every_file_is_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path))


def test_preview_reads_on(spark, tmp_path):
    (tmp_path / "f00.csv").write_text("")
    (tmp_path / "f01.csv").write_text("k,v\n")
    for i in range(30):
        (tmp_path / f"g{i:02}.csv").write_text(f"k,v\n{i},a\n")
    assert [r.k for r in preview_csv(spark, str(tmp_path)).collect()] == list(range(20))
    assert preview_csv(spark, str(tmp_path / "f01.csv")).count() == 0


def test_cleaned_rows_keep_their_order(spark, tmp_path, frame):
    df = frame(a=list(range(500))).repartition(7)
    path = write_cleaned(df, str(tmp_path), "f", "r")
    assert [r.a for r in read_csv(spark, path).df.orderBy(ROW_ID).collect()] == list(range(500))


def test_rows_are_numbered_in_ranges(spark):
    from limpid.catalog.records import numbered
    from limpid.sources.tables import ROW_ID

    df = spark.range(0, 5000, 1, 7).selectExpr(f"(id * 7919) % 5000 * 10 AS {ROW_ID}", "id")
    out = numbered(df, "position", 600)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 5000 and all(r[ROW_ID] == 10 * r.position for r in rows)
    assert numbered(df.where("false"), "position").count() == 0
