"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from limpid.llm import periodic_runs as periodic


def slow_runs(words):
    """(start, length, period) of all runs: every period is tried on every place."""
    found = {}
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words], int)
    for q in range(1, len(words) // 3 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for b, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - b + q >= max(24, 3 * q):
                found.setdefault((b, e + q), q)
    return sorted(((b, e - b, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_rest(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def slow_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words or doc_id is None:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def periodic_text(rng):
    """Words of nested periods: repeated parts that are themselves repeats, with breaks."""
    out = []
    while len(out) < rng.randrange(30, 400):
        part = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20]))]
        part *= rng.choice([1, 2, 4, 9])
        part += rng.choice([[], ["x"], ["a", "b"]])
        out += part * rng.choice([1, 1, 3, 4, 7])
        out += [rng.choice("abcxyz") for _ in range(rng.choice([0, 0, 1, 6]))]
    return [w.encode() for w in out]


def test_runs_of_nested_periods():
    rng = random.Random(5)
    documents = [periodic_text(rng) for _ in range(400)] + [[], [b"a"], [b"a"] * 24, [b"a"] * 23, [b"a", b"b"] * 500]
    got = periodic.find_runs(documents)
    assert got == [slow_runs(d) for d in documents]
    assert sum(map(len, got)) > 600 and max(q for runs in got for _, _, q in runs) > 60


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 30), st.integers(1, 6)), max_size=8), st.randoms())
@settings(max_examples=150, deadline=None)
def test_runs(parts, rng):
    words = []
    for letters, size, times in parts:
        words += [b"%d" % rng.randrange(letters) for _ in range(size)] * times
    assert periodic.find_runs([words]) == [slow_runs(words)]


def test_alone_and_together_are_the_same():
    rng = random.Random(8)
    documents = [periodic_text(rng) for _ in range(30)] * 2
    assert periodic.find_runs(documents) == [periodic.find_runs([d])[0] for d in documents]


def test_range_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = periodic.WaveletTree(values)
    for _ in range(200):
        low, high = sorted(rng.integers(0, 301, 2).tolist())
        x = int(rng.integers(0, 700))
        box = [np.array([v]) for v in (low, high, x)]
        inside = sorted(values[low:high].tolist())
        assert tree.below(*box)[0] == sum(v < x for v in inside)
        if inside:
            n = int(rng.integers(0, len(inside)))
            assert tree.nth(box[0], box[1], np.array([n]))[0] == inside[n]


def test_frames(spark, hard, empty, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_WORDS", 50)
    text = "lead " + "a b c " * 20 + "end"
    rows = spark.createDataFrame([(1, text, 4), (1, text, 4), (2, None, 5), (3, " \n ", 6), (None, "x y", 7)], "doc_id bigint, text string, runs int")
    found = periodic.with_runs(rows)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted((r.doc_id or 0, [tuple(s) for s in r.runs], r.collapsed) for r in found.collect())
    one = (1, [(1, 60, 3)], "lead a b c end")
    assert got == [(0, [], "x y"), one, one, (2, [], ""), (3, [], "")]
    assert periodic.with_runs(empty).count() == 0
    whole = periodic.with_runs(hard)
    assert whole.columns == [*hard.columns, "runs", "collapsed"] and whole.count() == hard.count()
    for r in whole.collect():
        words = (r.text or "").encode().split()
        assert [tuple(s) for s in r.runs] == slow_runs(words) if len(words) < 500 else True


def test_planted_periods(spark, hard):
    for r, s in zip(hard.select("doc_id", "text").collect(), periodic.with_planted_periods(hard.select("doc_id", "text")).collect()):
        assert (s.text or "").encode().split() == slow_planted(r.doc_id, (r.text or "").encode().split())


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode().split() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = periodic.op13_periodic_runs(spark, folder).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 50
    for r in rows:
        words = slow_planted(r.doc_id, texts[r.doc_id])
        runs = slow_runs(words) if len(words) < 6000 else periodic.find_runs([words])[0]
        top = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(slow_rest(words, runs))).hexdigest()
