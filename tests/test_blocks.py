"""CSV files read by blocks against the reader that gives a file to one task."""

import random

import pytest

from limpid.catalog import records
from limpid.sources import blocks
from limpid.sources.csv import preview_csv, read_csv, scan_csv
from limpid.sources.tables import ROW_ID, write_raw


def cell(rng):
    inside = lambda: "".join(rng.choice(["a", ",", "\n", '""', "b c", "\n\n", "x" * 30, "é"]) for _ in range(rng.randrange(6)))
    return rng.choice([
        lambda: rng.choice(["a", "bb", "é日", "x y", " lead", "", "n/a"]), lambda: f'"{inside()}"', lambda: f'"{inside()}"',
        lambda: 'st"ray', lambda: '"abc"def', lambda: '"li\nne"tail', lambda: '" sp" ', lambda: str(rng.randrange(1000))])()


def messy(rng, records, eol):
    rows = ["k,v,w"] + [",".join(cell(rng) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(records)]
    for _ in range(records // 20):
        rows.insert(rng.randrange(1, len(rows)), "")
    return eol.join(rows) + rng.choice(["", eol])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("seed, eol, size", [(1, "\n", 120), (2, "\r\n", 700), (3, "\n", 2500)])
def test_same_rows_and_ids(spark, tmp_path, seed, eol, size):
    rng = random.Random(seed)
    (tmp_path / "a.csv").write_bytes(messy(rng, 400, eol).encode())
    (tmp_path / "b.csv").write_bytes(f"k,v,w{eol}1,2,3{eol}".encode())
    (tmp_path / "c.csv").write_bytes(messy(rng, 200, eol).encode())
    whole = rows_of(scan_csv(spark, str(tmp_path)))
    assert len(whole) == 601 and any(r[-1] for r in whole)
    assert rows_of(scan_csv(spark, str(tmp_path), block_bytes=size)) == whole


def test_without_header_and_open_end(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('1,"x\ny"\n' * 50 + '2,"never\nclosed, at\nall')
    whole = rows_of(scan_csv(spark, str(path), has_header=False))
    assert rows_of(scan_csv(spark, str(path), has_header=False, block_bytes=64)) == whole and len(whole) == 51


def test_one_cell_over_many_blocks(spark, tmp_path):
    path = tmp_path / "a.csv"
    long = "line, with a comma\n" * 500
    path.write_text(f'k,v\n1,"{long}"\n2,"short"\n3,"{long}"\n')
    got = rows_of(scan_csv(spark, str(path), block_bytes=512))
    assert [(r[1], r[2]) for r in got] == [("1", long), ("2", "short"), ("3", long)]


def test_as_many_tasks_as_blocks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("k,v\n" + '1,"x\ny"\n' * 20_000)
    size = path.stat().st_size
    with blocks._split_size(spark, size // 10):
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            assert blocks._lines(spark, [str(path)]).rdd.getNumPartitions() >= 10
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
    df = read_csv(spark, str(path), block_bytes=size // 10).df
    assert [r[0] for r in df.select(ROW_ID).orderBy(ROW_ID).collect()] == list(range(20_000))


def test_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + "1,2\n" * 100)
    (tmp_path / "b.csv").write_text("k,other\n" + "1,2\n" * 100)
    with pytest.raises(ValueError, match="b.csv"):
        read_csv(spark, str(tmp_path), block_bytes=64)


def test_header_only_and_preview(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("key,value\r\n")
    assert read_csv(spark, str(path), block_bytes=2).df.count() == 0
    path.write_text("key,value\n" + '1,"a\nb"\n' * 100)
    assert preview_csv(spark, str(path)).count() == 20


def test_names_with_odd_characters(spark, tmp_path):
    for name in ("a b.csv", "ü+%41.csv"):
        (tmp_path / name).write_text("k,v\n" + '1,"x\ny"\n' * 30)
    whole = rows_of(scan_csv(spark, str(tmp_path)))
    assert len({r[0] for r in whole}) == 60 and rows_of(scan_csv(spark, str(tmp_path), block_bytes=64)) == whole
    assert preview_csv(spark, str(tmp_path / "a b.csv")).count() == 20


def test_documents_are_written_by_the_tasks_that_read_them(spark, tmp_path, monkeypatch):
    rows = [(i, f'line "{i}",\nnext, ' * 3, None if i % 5 else "en", f"s{i % 3}", i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    tasks = []
    monkeypatch.setattr(records, "write_raw", lambda df, *to: tasks.append(df.rdd.getNumPartitions()) or write_raw(df, *to))
    monkeypatch.setattr(records, "read_csv", lambda *of, block_bytes: read_csv(*of, block_bytes=200))
    assert sorted(tuple(r) for r in records.csv_documents_split(spark, str(tmp_path)).collect()) == rows
    assert tasks == [3]
