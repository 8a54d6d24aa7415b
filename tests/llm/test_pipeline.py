"""Stages of the pipeline on hard rows and on the test tables."""

import corpus_pipeline as C
from limpid.llm import components, language, simhash, substrings


def test_stages_on_hard_rows(spark, hard):
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    for name, step in C.STAGES[:-1]:
        out = step(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert step(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0, name
    assert C.packing(spark, docs, "").count() >= docs.count() and C.packing(spark, docs.where("false"), "").count() == 0
    left = C.language_id(spark, docs, "").collect()
    assert all(r.text and any(c.isalpha() for c in r.text) for r in left) and len(left) == 15


def test_the_language_stage_follows_its_model(spark, hard, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    right = C.language_id(spark, docs, "")
    given = {(r.doc_id, r.lang) for r in docs.collect()}
    found = [(r.doc_id, r.lang) for r in right.collect()]
    assert sum(x in given for x in found) > 0.9 * len(found)
    swapped = C.fit_language(docs)
    swapped.languages = swapped.languages[1:] + swapped.languages[:1]
    monkeypatch.setattr(C, "fit_language", lambda _: swapped)
    other = [(r.doc_id, r.lang) for r in C.language_id(spark, docs, "").collect()]
    assert len(other) == len(found) and not set(other) & set(found)


def test_whole_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = C.near_dedup(spark, docs, folder)
    groups = simhash.near_duplicates(docs)
    assert kept.count() == groups.select("component_id").distinct().count()
    rows = C.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert ids <= {r.doc_id for r in kept.collect()}
    clean = C.decontamination(spark, substrings.without_repeats(kept), folder)
    assert ids == {r.doc_id for r in clean.collect()}
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_small_parts_of_a_batch_change_nothing(spark, hard, monkeypatch):
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    rows = lambda step: sorted(map(str, step(spark, docs, "").collect()))
    before = rows(C.language_id), rows(C.substring_dedup)
    monkeypatch.setattr(language, "PART_CHARS", 40)
    monkeypatch.setattr(substrings, "PART_ROWS", 2)
    assert (rows(C.language_id), rows(C.substring_dedup)) == before


def test_near_dedup_broadcasts_no_variants(spark, monkeypatch):
    plans = []

    def seen(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return components.connected_components(links)

    monkeypatch.setattr(simhash, "connected_components", seen)
    folder = "/root/testdata/sf0.001"
    assert C.near_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() > 0
    assert len(plans) == 1 and "Broadcast" not in plans[0]
