"""Dated URL lists and benchmark containment against brute force."""

import random
import re

import pytest

from limpid.llm import decontaminate as D
from limpid.llm import url_lists as U
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module,name", [(U, "op8_url_list_join"), (D, "op1_benchmark_decontamination")])
def test_queries_equal_their_sql(spark, module, name):
    ok, message = compare(spark, connect(FOLDER), FOLDER, module.QUERIES[name], module.SQL[name])
    assert ok, message


ENTRIES = [
    ("a", "domain", "ex.com", "block", 10), ("a", "domain", "ex.com", "remove", 20), ("a", "domain", "ex.com", "block", 30),
    ("b", "host", "good.ex.com", "allow", 0), ("b", "prefix", "good.ex.com/bad", "block", 15), ("c", "prefix", "good.ex.com/bad", "allow", 40),
    ("c", "domain", "org", "block", 5), ("c", "domain", "org", "remove", 5), ("c", None, "x", "block", 1), ("c", "host", "n.net", "odd", 1),
    ("c", "host", "n.net", "block", None), ("d", "host", "t.net", "block", 1), ("e", "host", "t.net", "block", 1)]


def slow_verdict(url, at):
    if url is None or at is None:
        return "none", None
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url)
    host = m[1].lower().rstrip(".") if m else ""
    if not host:
        return "none", None
    parts = [s for s in m[2].split("/") if s]
    keys = {("host", host)} | {("domain", ".".join(host.split(".")[i:])) for i in range(host.count(".") + 1)}
    keys |= {("prefix", host + "/" + "/".join(parts[:k + 1])) for k in range(len(parts))}
    order = {"remove": 1, "block": 2, "allow": 3}
    best = None
    for l, s, v in {e[:3] for e in ENTRIES}:
        past = [(e[4], order[e[3]], e[3]) for e in ENTRIES if e[:3] == (l, s, v) and s and e[3] in order and e[4] is not None and e[4] <= at]
        if (s, v) in keys and past and max(past)[2] != "remove":
            grade = (("domain", "host", "prefix").index(s), len(v), max(past)[2] == "allow", [-ord(c) for c in l])
            if best is None or grade > best[0]:
                best = (grade, max(past)[2], l)
    return (best[1], best[2]) if best else ("none", None)


def test_verdicts(spark):
    urls = [None, "", "no url", "http://ex.com", "HTTP://u:p@Good.EX.com.:80/bad/x?q=/y#z", "https://good.ex.com//bad", "ftp://good.ex.com/badly",
            "http://sub.deep.ex.com/a/b", "http://site.org/", "http://notex.com/", "http://n.net", "http://t.net/a", "http:///path"]
    rows = [(u, t, "extra", k) for k, u in enumerate(urls) for t in (None, 0, 5, 10, 15, 19, 20, 35, 40, 99)] + [("http://ex.com", 10, "extra", 1)] * 3
    captures = spark.createDataFrame(rows, "url string, fetched_at bigint, verdict string, scope bigint")
    entries = spark.createDataFrame([(*e, 1) for e in ENTRIES], "list_name string, scope string, value string, action string, dated bigint, salt int")
    got = {(r.url, r.fetched_at): (r.verdict, r.list_name) for r in U.judge_urls(captures, entries, 3).collect()}
    assert got == {(u, t): slow_verdict(u, t) for u, t, *_ in rows}
    kept = U.filter_urls(captures, entries, 2)
    assert kept.columns == captures.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in captures.collect() if slow_verdict(r.url, r.fetched_at)[0] != "block")
    assert U.judge_urls(captures.where("false"), entries).count() == 0
    assert {r.verdict for r in U.judge_urls(captures, entries.where("false")).collect()} == {"none"}


def slow_containment(docs, items, size=5, threshold=0.8):
    def shingles(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return {" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    out = set()
    for i, t in items:
        own = shingles(t)
        for d, text in docs:
            if own and len(own & shingles(text)) / len(own) >= threshold - 1e-9:
                out.add((d, i))
    return out


def test_containment_of_hard_items(spark, hard, empty):
    docs = [tuple(r) for r in hard.select("doc_id", "text").collect()]
    rng = random.Random(4)
    long = next(t for i, t in docs if i == 7)
    words = long.split()
    items = [(1, None), (2, ""), (3, "x"), (4, " ".join(words[500:530])), (5, "A B"), (6, "y z"), (7, docs[0][1]), (7, "nothing like it at all here"), (None, "X!")]
    for k in range(8, 20):
        cut = words[k * 90:k * 90 + rng.randrange(5, 40)]
        for _ in range(rng.randrange(0, 3)):
            cut[rng.randrange(len(cut))] = "changed"
        items.append((k, " ".join(cut)))
    frame = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, doc_id bigint")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(hard, frame).collect()}
    assert got == slow_containment(docs, items)
    kept = D.without_contaminated(hard, frame)
    bad = {d for d, _ in got}
    assert kept.columns == hard.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in bad)
    assert D.contaminated(empty, frame).count() == 0 and D.contaminated(hard, frame.where("false")).count() == 0
    assert D.without_contaminated(hard, frame.where("false")).count() == hard.count()


def test_sketches_grow_with_the_size_class(spark):
    items = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n + 4))) for n in (1, 2, 10, 16, 17, 100)], "item_id bigint, text string")
    rows = {r.item_id: r for r in D.item_sketches(items).collect()}
    for n, r in rows.items():
        assert len(r.item_shingles) == n
        # a document may miss a fifth of the shingles and still holds a value of the sketch
        assert len(r.sketch) >= n - -(-n * 4 // 5) + 1 and len(r.sketch) <= n
    assert rows[16].size_class == 4 and rows[17].size_class == 5
