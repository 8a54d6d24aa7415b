"""Trained models: toxicity, language, and the Pitman-Yor scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from limpid.llm import language as L
from limpid.llm import pitman_yor as P
from limpid.llm import toxicity as X
from tests.llm.conftest import in_fold

FOLDER = "/root/testdata/sf0.01"


# --- toxicity ---

def slow_slots(text, bits):
    codes = [ord(c) for c in (text or "").lower()]
    found = set()
    for size in X.SIZES:
        for i in range(len(codes) - size + 1):
            h = codes[i]
            for c in codes[i + 1:i + size]:
                h = (h * 0x01000193 + c) % (1 << 32)
            found.add((h ^ h >> 15) * 0x85EBCA6B % (1 << 32) >> 32 - bits)
    return found


@pytest.mark.parametrize("text", [None, "", "abc", "abcd", "An ÄÖ 日本 text, an ÄÖ text", "a" * 500])
def test_slots(text):
    owner = np.zeros(1 << 12, np.int32)
    got = X.slots_of(text, owner, 12).tolist()
    assert len(got) == len(set(got)) and set(got) == slow_slots(text, 12)


def test_toxicity_of_held_out_documents(spark):
    rows = {r.doc_id: r for r in X.op3_toxicity(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == in_fold(i, 5) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(rows[i].score, t) for i, t in labels.items() if rows[i].held_out]
    good = [sum((a > b) + 0.5 * (a == b) for b, t in held if not t) for a, u in held if u]
    assert sum(good) / (len(good) * sum(not t for _, t in held)) > 0.85


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    texts = [(i, f"plain words number {i}" + (" awful insult" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = [(i, int(i % 3 == 0)) for i, _ in texts]
    turned = [(i, 1 - t if in_fold(i, 5) else t) for i, t in labels]
    models = [X.fit_toxicity(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (labels, turned)]
    assert all(np.array_equal(a, b) for a, b in zip(models[0][:2], models[1][:2])) and models[0][2] == models[1][2]
    scores = X.score_texts([t for _, t in texts], models[0])
    assert all((s > 0.5) == (i % 3 == 0) for s, (i, _) in zip(scores, texts))


def test_toxicity_of_hard_rows(hard, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = X.fit_toxicity(hard, none)
    assert {r.score for r in X.with_toxicity(hard, model).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 7), (2, 1), (2, 0), (3, 1), (999, 1)], "doc_id bigint, toxic int")
    scored = X.with_toxicity(hard, X.fit_toxicity(hard, odd), "component")
    assert scored.count() == hard.count() and scored.columns == hard.columns
    assert X.with_toxicity(empty, model).count() == 0 and len(X.fit_toxicity(empty, odd)[0]) == 0


# --- language ---

def test_gradient():
    rng = np.random.default_rng(1)
    model = L.new_model(["a", "b", "c"], 4)
    for name in ("tables", "recurrent"):
        setattr(model, name, [p.astype(np.float64) for p in getattr(model, name)])
    model.out, model.bias = model.out.astype(np.float64), model.bias.astype(np.float64)
    octets = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    live = (np.arange(6)[:, None] < np.array([6, 6, 3, 1, 5])).astype(np.float64)
    truth = np.array([0, 1, 2, 1, 0])
    _, found = L.gradients(model, octets, live, truth)
    for part, g in zip(model.parts(), found):
        for _ in range(10):
            at = tuple(int(rng.integers(0, s)) for s in part.shape)
            if part.shape[-1] == 256:
                at = (at[0], int(octets[rng.integers(0, 6), rng.integers(0, 5)]))
            kept, step = part[at], 1e-2
            part[at] = kept + step
            up = L.gradients(model, octets, live, truth)[0]
            part[at] = kept - step
            down = L.gradients(model, octets, live, truth)[0]
            part[at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_windows_hold_every_octet():
    texts = ["abc", None, "", "é" * 50, "x" * 128]
    flat, length, owner = L.windows_of(texts, 64)
    for k, text in enumerate(texts):
        assert b"".join(flat[j, :length[j]].tobytes() for j in np.flatnonzero(owner == k)) == (text or "").lower().encode()


def test_language_of_held_out_documents(spark):
    rows = {r.doc_id: r for r in L.op5_language_id(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(rows) == len(docs)
    held = [(rows[d.doc_id].lang_pred, d.lang) for d in docs if rows[d.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == in_fold(i, 5) for i, r in rows.items())


def test_letters():
    assert not any(map(L.has_letter, ["", "² ½", "Ⅷ ①", "12 _ ٣", "!? 日"[:3], "\u0301"]))
    assert all(map(L.has_letter, ["a", "² ª", "日", "12é", "\u02b0"]))
    model = L.train(["the cat and the dog"] * 9 + ["der Hund und die Katze"] * 9, ["en"] * 9 + ["de"] * 9, steps=3)
    assert L.predict(model, ["² ½", "Ⅷ ①", None, ""])[0] == ["und"] * 4 and L.predict(model, ["² ½"])[1].tolist() == [0.0]


def slow_predict(model, text, window):
    """One position after the other: both recurrent layers, the label of each octet, and their mean."""
    octets, total = text.lower().encode("utf-8", "surrogatepass"), np.zeros(len(model.languages))
    for at in range(0, len(octets), window):
        part = octets[at:at + window]
        layers = []
        for table, recurrent, order in zip(model.tables, model.recurrent, (range(len(part)), reversed(range(len(part))))):
            states = recurrent.shape[1]
            h, found = np.zeros(states), {}
            for t in order:
                x, m = table[:, part[t]].astype(float), recurrent.astype(float) @ h
                z = np.clip((x[:states] + m[:states]) * 0.25 + 0.5, 0, 1)
                r = np.clip((x[states:2 * states] + m[states:2 * states]) * 0.25 + 0.5, 0, 1)
                c = x[2 * states:] + r * m[2 * states:]
                h = z * h + (1 - z) * c / (1 + np.abs(c))
                found[t] = h
            layers.append(found)
        for t in range(len(part)):
            scores = model.out.astype(float) @ np.concatenate([layers[0][t], layers[1][t]]) + model.bias[:, 0]
            share = np.exp(scores - scores.max())
            total += share / share.sum()
    return model.languages[int(total.argmax())], total.max() / total.sum()


def test_predictions_against_a_loop_over_positions():
    rng = random.Random(2)
    texts = ["the cat and the dog of this house", "der Hund und die Katze von dem Haus", "le chat et le chien de la maison"]
    model = L.train(texts * 5, ["en", "de", "fr"] * 5, steps=40, window=16)
    many = [" ".join(rng.choices(" ".join(texts).split(), k=k)) + rng.choice(["", " é日", "!"]) for k in (1, 2, 5, 30, 60)]
    names, scores = L.predict(model, many, window=16, block=7)
    for text, name, score in zip(many, names, scores):
        want, share = slow_predict(model, text, 16)
        assert name == want and abs(score - share) < 1e-4


def test_language_of_hard_rows(hard, empty, spark):
    texts = [("the cat and the dog of this house", "en"), ("der Hund und die Katze von dem Haus", "de")] * 20
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = L.fit_language(docs)
    assert model.languages == ["de", "en"]
    scored = L.with_language(hard, model, "component", "first")
    rows = scored.collect()
    assert scored.columns == [*(c for c in hard.columns)] and len(rows) == hard.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.component == "und") == (not letters) and (r["first"] > 0) == letters
    nothing = L.fit_language(empty)
    assert {r.lang_pred for r in L.with_language(hard, nothing).collect()} == {"und"}
    assert L.with_language(empty, model).count() == 0


# --- Pitman-Yor ---

def scores(frame, held=None, **settings):
    return P.score_documents(frame, P.held_out(F.col("doc_id")) if held is None else held, **settings).collect()


def test_counts_and_base_score(hard):
    rows = [tuple(r) for r in hard.select("doc_id", "text").collect()]
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    learned = Counter(w for i, ws in tokens if not in_fold(i, 7, 2) for w in ws)
    n, v = sum(learned.values()), len(learned)
    want = sorted((-1 if i is None else i, in_fold(i, 7, 2), len(ws), sum(w in learned for w in ws), n,
                   round(sum(math.log10((learned[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    got = scores(hard, buckets=5)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_empty_and_untaught(hard, empty):
    assert scores(empty) == []
    for r in scores(hard, F.lit(True)):
        assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 and r.score == pytest.approx(0.0, abs=1e-9)


def test_probabilities_add_up():
    """After any context the known words and one unknown word have probability one."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    texts = [P.token_hashes(" ".join(rng.choices(words, range(1, 13), k=40))) for _ in range(50)]
    frequent = np.sort(P.token_hashes("w10 w11"))
    packed = [b.to_pylist()[0] for b in P._chunk_rows(7, texts, list(range(50)), [False] * 50, frequent, 1)]
    bucket = P.Bucket([r for r in packed if r["bucket"] == 0])
    assert bucket.total.sum() == sum(map(len, texts)) and len(bucket.words) == 13
    ones = [np.ones(n) for n in P._LEVELS]
    start = P.Totals(ones, ones, [0.5, 0.6, 0.7], int(bucket.total.sum()), 13)
    (levels, _, _), = bucket.sample(start, np.random.default_rng(1), 1, 3)
    (c3, t3), (c2, t2), (c1, t1) = levels
    assert np.array_equal(np.bincount(bucket.up, t3), c2) and np.array_equal(np.bincount(bucket.middle_word, t2), c1)
    base = 1 / 14
    root = P._smoothed(c1, t1, c1.sum(), t1.sum(), 0.7, base)
    unknown = P._smoothed(0, 0, c1.sum(), t1.sum(), 0.7, base)
    assert root.sum() + unknown == pytest.approx(1.0)

    def below(index, place, word, count, tables, discount, parent, parent_unknown):
        mine = index == place
        whole, used = count[mine].sum(), tables[mine].sum()
        full_c, full_t = np.zeros(13), np.zeros(13)
        full_c[word[mine]], full_t[word[mine]] = count[mine], tables[mine]
        share = P._smoothed(full_c, full_t, whole, used, discount, parent)
        rest = P._smoothed(0, 0, whole, used, discount, parent_unknown)
        assert share.sum() + rest == pytest.approx(1.0)
        return share, rest

    for place in set((bucket.deep // P.COARSE).tolist()):
        share, rest = below(bucket.middle_class, place, bucket.middle_word, c2, t2, 0.6, root, unknown)
        for deep in set(bucket.deep[bucket.deep // P.COARSE == place].tolist()):
            below(bucket.deep, deep, bucket.word, c3, t3, 0.5, share, rest)


def test_model_beats_the_base_on_text_with_order(spark):
    rng = random.Random(2)
    follow = {i: [rng.randrange(40) for _ in range(3)] for i in range(40)}

    def text():
        at, out = rng.randrange(40), []
        for _ in range(60):
            out.append(f"t{at}")
            at = rng.choice(follow[at])
        return " ".join(out)

    frame = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id bigint, text string")
    rows = [r for r in scores(frame, buckets=3) if r.held_out]
    assert sum(r.score for r in rows) > 0.6 * sum(r.base_score for r in rows)


def test_seating_is_consistent_and_follows_the_concentration():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 5, 400, 1, 90])
    few, many = (P.Seating(counts, 0.5, np.full(len(counts), w), rng) for w in (0.01, 50.0))
    for s, w in ((few, 0.01), (many, 50.0)):
        s.reseat(np.full(len(counts), w), 200)
        t = s.tables()
        assert (t[:2] == [0, 1]).all() and (t <= counts).all() and (t >= np.minimum(counts, 1)).all()
        for k, pair in enumerate(s.many):
            seats = s.seat[s.first[k]:s.first[k] + s.size_of[k]]
            assert len(set(seats.tolist())) == t[pair] and counts[pair] == s.guests[s.first[k]:s.first[k] + s.size_of[k]].sum()
    assert many.tables().sum() > few.tables().sum()


def test_gibbs_reaches_the_exact_distribution_of_two_customers():
    """Two customers share a table with probability (1 - d) / (1 - d + w)."""
    rng = np.random.default_rng(4)
    pairs, d, w = 40_000, 0.3, 0.9
    s = P.Seating(np.full(pairs, 2), d, np.full(pairs, w), rng)
    s.reseat(np.full(pairs, w), 10)
    assert abs((s.tables() == 1).mean() - (1 - d) / (1 - d + w)) < 0.01


def test_frequent_words_are_those_of_the_corpus(spark):
    """Every word is below one in 2048 of any batch, and the partitions favour different words."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join([w] * (3 if i < 20 else 1 + (i % 7 == 2)))) for i, w in enumerate(words)]
    frame = spark.createDataFrame(rows * 2, "doc_id bigint, text string").selectExpr("doc_id", "text", "doc_id % 5 = 4 AS held")
    counts = Counter(int(h) for i, t in rows * 2 if i % 5 != 4 for h in P.token_hashes(t))
    signed = {h: (h - (1 << 64) if h >> 63 else h) for h in counts}
    want = sorted(sorted(counts, key=lambda h: (-counts[h], signed[h]))[:40])
    for parts in (1, 7):
        for most in (50, 100_000):
            counted = P.count_words(frame.repartition(parts), most)
            assert P.frequent_words(counted, 40).tolist() == want
            assert counted.agg(F.sum("whole"), F.sum("taught")).first() == (
                sum(len(t.split()) + 1 for _, t in rows) * 2, sum(counts.values()))


def test_buckets_follow_the_tokens_and_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_TOKENS", 100)
    least = P.SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for words in (10, 9999):
        docs = spark.createDataFrame([(1, " ".join(f"w{i % 50}" for i in range(words)), False)], "doc_id bigint, text string, held boolean")
        assert P.bucket_number(P.count_words(docs)) == max(least, -(-(words + 1) // 100))
    monkeypatch.setattr(P, "CHUNK_DOCS", 2)
    texts = [(i, f"a b c{i % 3} a b d{i}", False) for i in range(20)]
    packed = P.packed_chunks(spark.createDataFrame(texts, "doc_id bigint, text string, held boolean").coalesce(1), np.empty(0, np.uint64), 2)
    rows = packed.where("bucket >= 0").collect()
    assert max(Counter((r.bucket, r.chunk) for r in rows).values()) == 1 and len({r.chunk for r in rows}) == 10
    monkeypatch.setattr(P, "WAITING_PAIRS", 3)
    buckets = [P.Bucket(r.asDict() for r in rows if r.bucket == b) for b in (0, 1)]
    seen = Counter(int(h) for _, t, _ in texts for h in P.token_hashes(t))
    assert {int(w): int(n) for b in buckets for w, n in zip(b.words, b.total)} == seen
    for r in rows:
        b = buckets[r.bucket]
        assert (b.deep[b.pairs_of(r)] == P._unpack(r.contexts, np.uint16)).all()


def test_a_round_visits_every_customer():
    rng = np.random.default_rng(5)
    counts = np.array([3, 2, 70, 1, 20_000, 0, 501])
    s = P.Seating(counts, 0.1, np.full(len(counts), 1e-9), rng)
    assert (s.tables() <= 1).sum() >= 3 and s.tables().sum() < 6000
    s.reseat(np.full(len(counts), 1e12), 1)
    # all open a table of their own
    assert s.tables().tolist() == counts.tolist()
    again = P.Seating.resumed(counts, 0.1, s.left(), rng)
    again.reseat(np.full(len(counts), 1e-9), 30)
    for k in range(len(again.many)):
        seats = again.seat[again.first[k]:again.first[k] + again.size_of[k]]
        used, guests = np.unique(seats, return_counts=True)
        assert again.held[k] == len(used) and (again.guests[used] == guests).all()
    assert again.tables()[0] < 3 and again.tables()[4] < 20_000


def test_batches_seat_like_single_moves(monkeypatch):
    found = []
    for turns in (P.TURNS, 10 ** 9):
        monkeypatch.setattr(P, "TURNS", turns)
        counts = np.full(300, 640)
        s = P.Seating(counts, 0.6, np.full(300, 4.0), np.random.default_rng(6))
        s.reseat(np.full(300, 4.0), 12)
        found.append(s.tables().mean())
    assert abs(found[0] / found[1] - 1) < 0.04


def test_totals_are_those_of_the_seating(spark):
    """Over all buckets, known words and one unknown word have probability one by the totals the scores use."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, range(1, 31), k=60)), i % 7 == 0) for i in range(120)],
                                 "doc_id bigint, text string, held boolean")
    packed = P.packed_chunks(docs, np.sort(P.token_hashes("w29 w28")), 4)
    state, kept = P.seated(packed, 4, 2, 2)
    rows = state.collect()
    assert len(kept) == 2 and {len(r.tables) for r in rows} == {6}
    for k, totals in enumerate(kept):
        seen = {}
        for r in rows:
            b = P.Bucket.resumed(r.asDict())
            levels = b.levels([P._unpack(t, np.int64) for t in r.tables[3 * k:3 * k + 3]])
            assert all((c >= t).all() for c, t in levels)
            seen[r.bucket] = (b, levels)
            for index, (c, t), n in ((b.deep, levels[0], 0), (b.middle_class, levels[1], 1), (np.zeros(len(b.words), int), levels[2], 2)):
                totals.customers[n] = totals.customers[n] - np.bincount(index, c, P._LEVELS[n])
                totals.tables[n] = totals.tables[n] - np.bincount(index, t, P._LEVELS[n])
        assert all((x == 0).all() for x in totals.customers + totals.tables)
        sums = [np.sum([np.bincount(i, x, P._LEVELS[n]) for b, ls in seen.values() for i, x in [
            ((b.deep, b.middle_class, np.zeros(len(b.words), int))[n], ls[n][j])]], axis=0) for j in (0, 1) for n in range(3)]
        totals.customers, totals.tables = sums[:3], sums[3:]
        known = 0.0
        for b, levels in seen.values():
            known += b.chances(levels, totals)[2][b.total > 0].sum()
        base = 1 / (totals.words + 1)
        unknown = P._smoothed(0, 0, totals.customers[2][0], totals.tables[2][0], totals.discounts[2], base)
        assert known + unknown == pytest.approx(1.0)


def slow_tables(count, d, w):
    """Probabilities of 1, 2, ... tables, each seating by its weight w^tables times (1 - d)...(guests - 1 - d) per table."""
    logs = [0.0]
    for c in range(1, count):
        joined = [x + math.log(c - d * t) for t, x in enumerate(logs, 1)]
        logs = [np.logaddexp(a, b) for a, b in zip([-np.inf, *logs], [*joined, -np.inf])]
    logs = np.array(logs) + np.arange(1, count + 1) * math.log(w)
    chance = np.exp(logs - logs.max())
    return chance / chance.sum()


@pytest.mark.parametrize("d", [0.05, 0.5, 0.8])
def test_chances_of_many_customers_are_exact(d):
    for count in (P.LISTED + 1, P.LISTED + 400):
        for w in (1e-9, 0.3, 20.0, 600.0, 2e4, 3e5, 1e9, 1e30):
            tables, chance = P.table_chances(count, d, w)
            got = np.zeros(count)
            got[tables - 1] = chance
            assert abs(got - slow_tables(count, d, w)).sum() < 2e-6


def test_draws_follow_the_exact_distribution():
    rng = np.random.default_rng(8)
    for count, d, w in [(2, 0.8, 0.4), (3, 0.3, 2.0), (9, 0.7, 0.05), (40, 0.6, 3.0), (40, 0.6, 1e12), (P.LISTED, 0.5, 40.0), (P.LISTED + 1, 0.5, 40.0)]:
        n = 20_000 if count <= P.LISTED else 800
        found = P.drawn_tables(np.full(n, count), d, np.full(n, w), rng)
        assert abs(np.bincount(found, minlength=count + 1)[1:] / n - slow_tables(count, d, w)).max() < 2.5 / math.sqrt(n)
    assert P.drawn_tables(np.array([0, 1, 0, 1]), 0.5, np.ones(4), rng).tolist() == [0, 1, 0, 1]
    assert P.drawn_tables(np.array([5, 3000]), 0.5, np.zeros(2), rng).tolist() == [1, 1] and len(P.drawn_tables(np.empty(0, np.int64), 0.5, np.empty(0), rng)) == 0


def test_draws_seat_like_customers_one_by_one(monkeypatch):
    monkeypatch.setattr(P, "TURNS", 10 ** 9)
    rng = np.random.default_rng(9)
    for count, d, w in [(4, 0.7, 0.5), (20, 0.8, 2.0), (40, 0.6, 4.0)]:
        s = P.Seating(np.full(2000, count), d, np.full(2000, w), rng)
        s.reseat(np.full(2000, w), 60)
        drawn = P.drawn_tables(np.full(20_000, count), d, np.full(20_000, w), rng)
        assert abs(s.tables().mean() / drawn.mean() - 1) < 0.05 and abs(s.tables().std() / drawn.std() - 1) < 0.1


def test_what_is_staged_follows_the_pairs_and_not_the_customers():
    """A word that comes 200 million times takes no more room or work than one that comes twice."""
    sizes = {}
    for n in (2, 200_000_000):
        row = {"words": P._pack(np.arange(3, dtype=np.uint64)), "lengths": P._pack(np.array([2, 1, 1], np.int32)),
               "contexts": P._pack(np.array([5, 9, 5, 7], np.uint16)), "counts": P._pack(np.array([n, 1, n, 3]))}
        bucket = P.Bucket.resumed(row)
        known = P.Totals([np.ones(m) for m in P._LEVELS], [np.full(m, 1e3) for m in P._LEVELS], [0.5, 0.6, 0.7], 2 * n + 4, 3)
        for levels, _, _ in bucket.sample(known, np.random.default_rng(1), 2, 3):
            assert all((c >= t).all() and (t >= np.minimum(c, 1)).all() for c, t in levels)
        sizes[n] = P._state(0, bucket, levels, []).nbytes
    assert sizes[200_000_000] < sizes[2] + 200


def test_places_are_in_order():
    rng = np.random.default_rng(10)
    tokens = rng.integers(0, 300, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    context, bucket = rng.integers(0, P._LEVELS[0], 5000).astype(np.uint16), (tokens % np.uint64(7)).astype(np.int64)
    assert np.array_equal(P._order(tokens, context, bucket), np.lexsort((context, tokens, bucket)))
    frequent = np.sort(np.unique(tokens)[:9])
    apart = [P.contexts_of(t, frequent) for t in np.split(tokens, [1, 2, 40, 4999])]
    assert np.array_equal(np.concatenate(apart), P._contexts(tokens, np.array([0, 1, 2, 40, 4999]), frequent))


def test_superseded_seatings_are_deleted(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c{i % 3} a b d{i}", False) for i in range(20)], "doc_id bigint, text string, held boolean")
    monkeypatch.setattr("limpid.session.shared_folder", lambda spark: str(tmp_path))
    packed = P.packed_chunks(docs, np.empty(0, np.uint64), 20)
    state, _ = P.seated(packed, 20, 1, 3)
    assert len([p for p in (tmp_path / "limpid").iterdir() if p.name.startswith("seating")]) == 1 and state.count() == len({r.bucket for r in state.collect()})
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert P.by_bucket(packed, 20 * least, "bucket", "chunk").rdd.getNumPartitions() <= 20 * least // P.IN_TURN + 1
    with pytest.raises(ValueError):
        P.unstage(spark.read.parquet(f"{FOLDER}/documents.parquet"))
