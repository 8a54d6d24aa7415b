"""Hilbert order, runs of equal size and the files written from them."""

import itertools

import pytest
from pyspark.sql import functions as F

from limpid.llm import sharding as S


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 2), (1, 4), (2, 1), (5, 1)])
def test_curve_visits_every_point_by_single_steps(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    names = [f"c{i}" for i in range(n)]
    frame = spark.createDataFrame(points, ", ".join(f"{c} bigint" for c in names))
    rows = frame.select(*names, S.hilbert_index([F.col(c) for c in names], bits).alias("place")).collect()
    order = sorted(rows, key=lambda r: r.place)
    assert [r.place for r in order] == list(range(len(points)))
    assert all(sum(abs(a[c] - b[c]) for c in names) == 1 for a, b in zip(order, order[1:]))


def checked(frame, shards, dimensions):
    rows = S.shard_rows(frame, dimensions, shards).collect()
    total = frame.count()
    assert len(rows) == total
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in order] == sorted(r.curve_index for r in rows)
    sizes = [sum(r.shard == k for r in rows) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    return rows


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_hard_rows(hard, shards):
    checked(hard.union(hard).union(hard), shards, ["lang", "source", "n_chars", "doc_id"])


def test_one_value_for_all(spark):
    frame = spark.createDataFrame([(1, "same", None)] * 95, "doc_id bigint, source string, lang string")
    checked(frame, 10, ["lang", "source", "doc_id"])


def test_empty_and_clashing_names(empty, spark):
    assert S.shard_rows(empty, ["lang", "doc_id"]).count() == 0
    frame = spark.createDataFrame([(i, "x", i) for i in range(20)], "doc_id bigint, shard string, slot bigint")
    rows = S.shard_rows(frame, ["doc_id"], 4).collect()
    assert sorted(r.shard for r in rows) == sorted(i * 4 // 20 for i in range(20))


def test_levels_are_counts_of_bounds(spark):
    frame = spark.range(200).select(F.col("id").cast("double").alias("x"))
    bounds = (3.0, 10.0, 10.5, 150.0)
    rows = frame.select("x", S._level(F.col("x"), bounds).alias("l")).collect()
    assert all(r.l == sum(b <= r.x for b in bounds) for r in rows)
    assert spark.sql("select cast(null as double) x").select(S._level(F.col("x"), bounds)).first()[0] == 0


def test_text_levels_follow_the_text_order(spark):
    names = [f"https://site{i:03}.example" for i in range(64)]
    frame = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, doc_id bigint")
    grid = S.fit_grid(frame, ["source"], 4)
    assert grid.dimensions[0][1] == len("https://site0")
    levels = [r[1] for r in S.with_curve(frame, grid).select("source", "curve_index").orderBy("source").collect()]
    assert levels == sorted(levels) and len(set(levels)) == 16


def test_query_and_files(spark, tmp_path):
    rows = S.op2_hilbert_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    import zlib
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    S.write_shards(frame, str(tmp_path / "out"), S.DIMENSIONS, 4, rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.select(*frame.columns).collect()) == sorted(frame.collect())
    files = back.groupBy(F.input_file_name()).agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("z")).collect()
    assert sum(f.z < 5_000 for f in files) > len(files) // 3   # a filter on length skips many files
