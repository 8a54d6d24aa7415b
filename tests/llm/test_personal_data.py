"""Identifiers against the plain patterns, and disguised ones against their places in the source."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from limpid.llm import personal_data as pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def slow_base(text):
    keep = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(re.sub(r"\D", "", s, flags=re.A)) <= 19 and slow_luhn(re.sub(r"\D", "", s, flags=re.A)),
        "phone": lambda s: 9 <= len(re.sub(r"\D", "", s, flags=re.A)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if keep[k](m.group())]


PIECES = ["a", "b.c", "@", "_", ".", "-", " ", "1", "255", "256", "0", "4111 1111 1111 1111", "+1 ", "(555)", "é", "日", "x@y.z", "+", "%"]


@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_open_identifiers(text):
    assert pii.find_plain(text) == slow_base(text)


@given(st.lists(st.sampled_from([*PIECES, " at ", " dot ", "[at]", "five ", "one", "а", "​", "１", "plus "]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_open_ones_stay_and_spans_lie_in_the_text(text):
    base, every = pii.find_personal_data(text)
    assert base == slow_base(text) and set(base) <= set(every) and len(set(every)) == len(every)
    assert all(0 <= s < e <= len(text) for _, s, e in every)


@pytest.mark.parametrize("kind, part", [
    ("email", "john [at] example [dot] com"), ("email", "john.doe at example dot com"), ("email", "ann(@)mail(.)org"),
    ("email", "jоhn@ехample.com"), ("email", "a​b@c​d.de"), ("email", "ｊｏｈｎ＠example.com"), ("email", "max ät web punkt de"),
    ("phone", "plus one five five five one two three four five six seven"), ("phone", "+1 (555) five five five one two three four"),
    ("phone", "+١ ٥٥٥ ٠١٠٠ 77"), ("phone", "+49 30 1234567"),
    ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "10․0․0․1"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "４１１１ １１１１ １１１１ １１１１"),
])
def test_disguises(kind, part):
    for before, after in [("", ""), ("Ünter 日本 ", " und"), ("see \U0001d7ce: ", ", so")]:
        text = before + part + after
        assert (kind, len(before), len(before) + len(part)) in pii.find_personal_data(text)[1]


def test_clean_texts_have_none():
    for text in ["we met at noon", "one of two, three or four", "look at page 3 point 4", "the zero one two", "un deux trois 1234567",
                 "+1 (848) 555-1373 Un an", "1 at a dot b", "Москва а потом", "[at] the [dot]"]:
        assert pii.find_disguised(text) == []


def test_long_texts_take_linear_time():
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "@a.b " * 60_000 + "a." * 100_000 + " one" * 50_000 + " at" * 50_000 + "+1" + " " * 200_000
    start = time.perf_counter()
    pii.find_personal_data(text)
    assert time.perf_counter() - start < 30


def test_mask():
    assert pii.mask("mail a@b.c or x [at] y [dot] org") == "mail <email> or <email>"
    assert pii.mask("") == "" and pii.mask(None) is None and pii.mask("plain é") == "plain é"


def test_frames(spark, hard, empty):
    rows = spark.createDataFrame([(1, "at a@b.co, 10.0.0.1", 5), (1, "at a@b.co, 10.0.0.1", 5), (2, None, 6), (3, "", 7), (None, "é +1 555 555 0100", 8)],
                                 "doc_id bigint, text string, personal int")
    found = pii.with_spans(rows)
    assert found.columns == ["doc_id", "text", "personal"]
    got = sorted((r.doc_id or 0, [tuple(s) for s in r.personal["open"]], [tuple(s) for s in r.personal["all"]]) for r in found.collect())
    mail = [("email", 3, 9), ("ip", 11, 19)]
    assert got == [(0, [("phone", 2, 17)], [("phone", 2, 17)]), (1, mail, mail), (1, mail, mail), (2, [], []), (3, [], [])]
    assert pii.with_spans(empty).count() == 0 and pii.with_spans(hard).count() == hard.count()
    assert pii.redacted(rows).where("doc_id = 1").first().text == "at <email>, <ip>"
    assert pii.redacted(hard).exceptAll(hard).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = pii.op12_personal_data(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = slow_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(","))
