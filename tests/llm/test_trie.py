"""The prefix trie against brute force over whole paths."""

import hashlib
import random
import zlib

import pytest

from limpid.llm import prefix_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_trie(conversations):
    """{conv_id: [(role, text), ...]} to rows in the order of COLUMNS."""
    members = {}
    for c, said in conversations.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    rows = []
    for path, inside in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = sorted(c for c in inside if len(conversations[c]) == len(path))
        rows.append((min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), len(children), len(leaves), saved,
                     hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=repr)


def slow_rebuilt(conversations):
    def one(c):
        h = zlib.crc32(str(c).encode()) % 9
        return conversations.get(c - c % 5, [])[:h] + conversations[c][h:]
    return {c: one(c) for c in conversations}


def ordered(rows):
    """Turns per conversation; null turn first, ties by digest, gaps as empty texts."""
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            digest = hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest()
            found.setdefault(c, []).append((turn is not None, turn or 0, digest, said))
    return {c: [s[3] for s in sorted(v)] for c, v in found.items()}


def frame_of(spark, rows):
    """With further columns whose names occur inside the operator."""
    return spark.createDataFrame([(*r, i, "x", None, 7) for i, r in enumerate(rows)],
                                 "conv_id bigint, turn bigint, role string, text string, place int, key string, depth int, part int")


def sample(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(2 * n), n):
        for turn in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None, "é"]),
                         rng.choice(["a", "a", "b", "", None, "日本", "user"])))
    rows += [(None, 1, "user", "lost"), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("band", [3, 16])
def test_nodes(spark, band):
    rows = sample(band)
    assert got(trie.conversation_trie(frame_of(spark, rows), band)) == slow_trie(ordered(rows))


def test_rebuilt(spark):
    rows = sample(9, 90)
    turns, members = trie.rebuilt_turns(frame_of(spark, rows))
    want = slow_rebuilt(ordered(rows))
    assert any(not said for said in want.values())
    assert got(trie.prefix_trie(turns, members)) == slow_trie(want)


def test_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    monkeypatch.setattr(trie, "CHUNK", 40)
    long = [(0, i, "user", f"t{i % 3}") for i in range(70)]
    near = [(5, i, "user", f"t{i % 3}" if i < 66 else "end") for i in range(70)]
    copies = [(c, i, "user", f"t{i}") for c in range(100, 160) for i in range(3)]
    rows = long + near + copies
    want = slow_trie(ordered(rows))
    for band in (4,):
        assert got(trie.conversation_trie(frame_of(spark, rows), band)) == want


def test_ranges_cut_a_conversation(spark):
    rows = [(3, i // 2, "user", f"t{i}") for i in range(400)] + [(c, 0, "user", "x") for c in range(20)]
    places = trie.numbered_turns(frame_of(spark, rows)).where("conv_id = 3").orderBy("place").collect()
    assert [r.place for r in places] == list(range(1, len(places) + 1)) and len(places) == 401


def test_shared_turns_once(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", None), (2, 0, "user", "hi"), (2, 1, "bot", "yes"), (3, 0, "user", "hi")]
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.role, r.text) for r in trie.trie_turns(frame_of(spark, rows)).collect()}
    assert found == {(1, 1): (1, 3, "user", "hi"), (1, 2): (1, 1, "bot", ""), (2, 2): (1, 1, "bot", "yes")}


def test_empty(spark):
    nothing = frame_of(spark, sample(1)).where("false")
    turns, members = trie.rebuilt_turns(nothing)
    assert trie.prefix_trie(turns, members).count() == 0
    assert trie.trie_turns(nothing).count() == 0
