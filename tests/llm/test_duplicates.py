"""SimHash groups, components and repeated windows against brute force."""

import hashlib
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from limpid.llm import simhash, substrings
from limpid.llm.components import connected_components


def slow_fingerprint(text, size=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def slow_components(links, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@given(st.lists(st.sampled_from(["a", "B", "cé", "É", "x1"]), max_size=9), st.sampled_from([" ", "\n", "\t \x0b"]))
@settings(max_examples=60, deadline=None)
def test_fingerprint(words, gap):
    assert simhash.fingerprint(gap.join(words)) == slow_fingerprint(gap.join(words))


def test_only_ascii_letters_and_spaces_are_special():
    assert simhash.fingerprint("É b") != simhash.fingerprint("é b")
    assert simhash.fingerprint("a b c") != simhash.fingerprint("a b c")


def test_variants_are_not_broadcast(spark, tmp_path):
    """66 variants come from a fingerprint, but Spark sizes them like one: they must not go through the driver."""
    path = str(tmp_path / "prints")
    spark.range(2000).selectExpr("xxhash64(id) AS fingerprint").union(spark.sql("SELECT 5L UNION ALL SELECT 4L")).write.parquet(path)
    links = simhash.near_links(spark.read.parquet(path))
    assert [tuple(r) for r in links.distinct().collect() if {r.a, r.b} <= {4, 5}] == [(4, 5)]
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, k) for k in range(101, 160)]
    pairs = chain + star + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (-3, 300)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    linked = [p for p in pairs if p[0] != p[1]]
    assert got == slow_components(linked, {n for p in linked for n in p})
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_links(spark, distance):
    rng = random.Random(distance)
    values = {0, -1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(4):
            for bit in rng.sample(range(64), rng.randrange(0, 7)):
                base ^= 1 << bit
            values.add(base - (1 << 64) if base >> 63 else base)
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    got = {tuple(sorted(r)) for r in simhash.near_links(frame, distance).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if bin((a ^ b) & mask).count("1") <= distance}
    assert got == want


def test_near_duplicates_of_hard_rows(hard, empty):
    rows = [tuple(r) for r in hard.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(hard).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, slow_fingerprint(t)) for i, t in rows)
    values = sorted({slow_fingerprint(t) for _, t in rows})
    mask = (1 << 64) - 1
    part = slow_components([(a, b) for a in values for b in values if bin((a ^ b) & mask).count("1") <= 3], values)
    least = {}
    for i, t in rows:
        if i is not None:
            key = part[slow_fingerprint(t)]
            least[key] = min(least.get(key, i), i)
    assert all(r.component_id == least[part[r.fingerprint]] for r in got)
    kept = simhash.keep_one_of_each(hard)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0


def test_only_null_ids_keep_one(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id bigint, text string")
    assert simhash.keep_one_of_each(frame).count() == 1


def slow_removal(rows, window):
    starts = {}
    for i, t in rows:
        words = (t or "").encode().split()
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k:k + window])
                starts[key] = min(starts.get(key, i), i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        keep = [True] * len(words)
        if i is not None:
            for k in range(len(words) - window + 1):
                if starts[tuple(words[k:k + window])] < i:
                    keep[k:k + window] = [False] * window
        left = [w for w, k in zip(words, keep) if k]
        out.append((-1 if i is None else i, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out)


def removal(frame, **settings):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                  for r in substrings.removal_counts(frame, **settings).collect())


@pytest.mark.parametrize("bucket_rows", [2048, 2])
def test_hard_rows(hard, empty, monkeypatch, bucket_rows):
    monkeypatch.setattr(substrings, "BUCKET_ROWS", bucket_rows)
    rows = [tuple(r) for r in hard.select("doc_id", "text").collect()]
    assert removal(hard) == slow_removal(rows, 50)
    assert removal(empty) == []
    cut = substrings.without_repeats(hard)
    assert cut.columns == hard.columns and cut.count() == hard.count()
    texts = {r.doc_id: r.text for r in cut.where("doc_id in (5, 6, 7, 12, 13)").collect()}
    before = {r.doc_id: r.text for r in hard.where("doc_id in (5, 6, 7, 12, 13)").collect()}
    assert all(texts[i] == before[i] for i in (5, 6, 7, 12))
    assert texts[13] == "other start and another end"
    assert substrings.without_repeats(empty).count() == 0


@pytest.mark.parametrize("window,minimiser,bucket_rows", [(4, 2, 2048), (4, 2, 3), (3, 3, 2), (1, 1, 4), (6, 8, 5)])
def test_random_words(spark, monkeypatch, window, minimiser, bucket_rows):
    monkeypatch.setattr(substrings, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(window)
    rows = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 25)))) for _ in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert removal(frame, window=window, minimiser=minimiser) == slow_removal(rows, window)


def test_words_split_at_ascii_white_space_only():
    assert substrings.words_of("a b\x0bc\x1cd e f") == ["a b".encode(), b"c\x1cd\xe2\x80\x83e", b"f"]


@pytest.mark.parametrize("text,window,minimiser", [
    ("a " * 300, 50, 8), ("a b " * 90, 20, 3), ("x y z w " * 9 + "q " * 40, 10, 4), ("one two three four five six seven", 3, 2), ("k", 1, 1)])
def test_super_kmers_cover_every_window_once(text, window, minimiser):
    words = substrings.words_of(text)
    keys, first, count = substrings.super_kmers(words, window, minimiser)
    n = max(0, len(words) - window + 1)
    assert first.tolist() == [sum(count[:k]) for k in range(len(first))] and sum(count) == n
    size = min(minimiser, window)
    same = {}
    for k, f, c in zip(keys.tolist(), first.tolist(), count.tolist()):
        assert c <= window - size + 1
        for at in range(f, f + c):      # equal windows have one key
            assert same.setdefault(tuple(words[at:at + window]), k) == k
    if len(set(words)) == 1 and n > window:
        assert len(first) <= n // (window - size + 1) + 1


def test_many_copies_of_a_row_list_their_cuts_once(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(7, text)] * 300 + [(3, text + " tail"), (9, "head " + text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.removal_counts(docs).collect()}
    assert found == {(7, 200, 200), (3, 201, 0), (9, 201, 200)}
    keyed = docs.selectExpr("doc_id", "xxhash64(text) AS digest", "text")
    listed = substrings._listed(keyed, 50, 8).selectExpr("*", "0 AS part", "1 AS parts")
    packed = substrings._packed(keyed, listed, 50).where("doc_id = 7").count()
    assert packed == listed.where("doc_id = 7").distinct().count() < 50
