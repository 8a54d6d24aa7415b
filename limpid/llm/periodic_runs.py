"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q that no neighbouring word extends, at least
``MIN_LENGTH`` words and ``MIN_REPEATS`` periods long. Let m be 8 or the largest power of two up to q,
whichever is larger: such a run contains a block of m words that begins at a multiple of m, and that
block again q words later. So each dyadic block asks for its own occurrences in the neighbouring
window of its length. The suffix array holds the occurrences of a block as one interval; a wavelet
tree over it answers "the smallest place in this interval from x on" (range successor) without
listing them. Occurrences in one window form an arithmetic progression, and a progression leaves at
most two periods to try: its own step, or the distance of the two stretches with that step.
Every candidate is then extended by longest common extensions over the ranks of dyadic factors.

Documents of a batch are worked on together: ranks begin with the number of the document, so no factor
crosses a border, and after eight words only documents with a repeated factor go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LENGTH = 24
MIN_REPEATS = 3
# least length of a block; with it one block serves all periods below twice its length
BASE = 3
# words that are worked on together, unless one document has more
SLICE_WORDS = 200_000


class Factors:
    """Suffix array of several documents, and the rank of every factor of 2^k words.

    ``ids`` are word numbers, ``ends`` the end of the document each place lies in. The rank of a place
    at level k is where the suffixes begin that share its first 2^k words (with the end of the document as a last
    word), so equal ranks are equal factors of one document.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray, levels: int | None = None):
        n = len(ids)
        self.ends = ends
        # the end of a document is as good as its number
        order = np.lexsort((ids, ends))
        self.suffixes = order
        firsts = np.flatnonzero(self._changes(ends[order], ids[order]))
        self.ranks = [self._ranked(np.empty(n, np.int32), order, firsts, np.arange(n))]
        self._open = self._repeated(self.ranks[0], np.arange(n))
        while len(self._open) and (levels is None or len(self.ranks) <= levels):
            self._double()

    @staticmethod
    def _changes(*keys: np.ndarray) -> np.ndarray:
        """Where a sorted sequence of keys begins anew."""
        new = np.ones(len(keys[0]), bool)
        if len(new):
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return new

    @staticmethod
    def _ranked(rank: np.ndarray, order: np.ndarray, firsts: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Write to ``rank`` of the places in ``order`` the slot where their group begins."""
        sizes = np.diff(np.append(firsts, len(order)))
        rank[order] = np.repeat(slots[firsts], sizes)
        return rank

    def _repeated(self, rank: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Slots, out of ``slots``, of suffixes that share their rank with another."""
        found = rank[self.suffixes[slots]]
        new = self._changes(found)
        alone = new & np.append(new[1:], True)
        return slots[~alone]

    def _double(self) -> None:
        """Ranks of the next level: only suffixes that are not told apart yet are sorted on."""
        rank, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
        places = self.suffixes[self._open]
        after = places + step
        inside = after < self.ends[places]
        then = np.where(inside, rank[np.where(inside, after, 0)], -1)
        order = np.lexsort((then, rank[places]))
        places, then = places[order], then[order]
        self.suffixes[self._open] = places
        firsts = np.flatnonzero(self._changes(rank[places], then))
        self.ranks.append(self._ranked(rank.copy(), places, firsts, self._open))
        self._open = self._repeated(self.ranks[-1], self._open)

    def rank(self, level: int) -> np.ndarray:
        """Ranks at a level; beyond the last one every factor is alone."""
        return self.ranks[min(level, len(self.ranks) - 1)]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from places a and b > a on, inside their document."""
        a, b, size = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        end = self.ends[np.minimum(a, len(self.ends) - 1)]
        for level in reversed(range(len(self.ranks))):
            rank, step = self.ranks[level], 1 << level
            inside = b + step <= end
            same = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])
            a, b, size = a + same * step, b + same * step, size + same * step
        return size

    def backward(self, a: np.ndarray, b: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Number of equal words before places a and b > a, not before ``begins``."""
        a, b, size = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.ranks))):
            rank, step = self.ranks[level], 1 << level
            inside = a - step >= begins
            same = inside & (rank[np.where(inside, a - step, 0)] == rank[np.where(inside, b - step, 0)])
            a, b, size = a - same * step, b - same * step, size + same * step
        return size


class WaveletTree:
    """Range successor over an array of distinct numbers below its length.

    Level by level, from the highest bit on, the numbers are parted by that bit, in order; ``zeros``
    counts the numbers with a 0 before each slot.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers in slots low to before high are smaller than x."""
        count = np.zeros(len(low), np.int64)
        whole = x >= 1 << self.bits
        size = high - low
        for zeros, bit in zip(self.zeros, reversed(range(self.bits))):
            left, right = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = (x >> bit & 1).astype(bool)
            count += np.where(one, right - left, 0)
            low = np.where(one, zeros[-1] + low - left, left)
            high = np.where(one, zeros[-1] + high - right, right)
        return np.where(whole, size, count)

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest number (from 0) in slots low to before high; n must be below their count."""
        found, n = np.zeros(len(low), np.int64), n.copy()
        for zeros, bit in zip(self.zeros, reversed(range(self.bits))):
            left, right = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = n >= right - left
            n = np.where(one, n - (right - left), n)
            found += one * (1 << bit)
            low = np.where(one, zeros[-1] + low - left, left)
            high = np.where(one, zeros[-1] + high - right, right)
        return found


def _candidates(f: Factors, tree: WaveletTree, begins: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of a block, distance to try) from the blocks of 2^level words."""
    m = 1 << level
    places = np.arange(len(f.ends))
    rank = f.rank(level)
    sizes = np.bincount(rank, minlength=len(rank))
    # blocks that lie in their document and occur there again
    blocks = places[((places - begins) % m == 0) & (places + m <= f.ends) & (sizes[rank] > 1)]
    low = rank[blocks].astype(np.int64)
    high = low + sizes[low]
    found = []
    if level == BASE:
        # periods below a block's length: the block overlaps itself, the next occurrence tells its own period
        first = tree.below(low, high, blocks + 1)
        near = (tree.below(low, high, blocks + m) > first)
        s = blocks[near]
        found.append((s, tree.nth(low[near], high[near], first[near]) - s))
    first = tree.below(low, high, blocks + m)
    count = tree.below(low, high, blocks + 2 * m) - first
    some = count > 0
    s, low, high, first, count = blocks[some], low[some], high[some], first[some], count[some]
    one = tree.nth(low, high, first)
    found.append((s, one - s))
    more = count > 1
    s, low, high, first, count, one = (x[more] for x in (s, low, high, first, count, one))
    two = tree.nth(low, high, first + 1)
    pair = count == 2
    found.append((s[pair], two[pair] - s[pair]))
    # three or more: the block has the step of the progression as period, here and there; a longer
    # period must carry one end of the stretch with that step around the block to the other stretch
    s, one, step = s[~pair], one[~pair], two[~pair] - one[~pair]
    begin_s, end_s = _stretch(f, s, step, begins[s])
    begin_o, end_o = _stretch(f, one, step, begins[s])
    apart = begin_s != begin_o
    for q in (begin_o - begin_s, end_o - end_s):
        fits = apart & (q >= m) & (q < 2 * m)
        found.append((s[fits], q[fits]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _stretch(f: Factors, place: np.ndarray, period: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the longest stretch through ``place`` whose words recur after ``period``."""
    begin = place - f.backward(place, place + period, begins)
    return begin, place + period + f.forward(place, place + period)


def find_runs(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, by start, then period."""
    sizes = np.array([len(words) for words in documents], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    long = np.flatnonzero(sizes >= MIN_LENGTH)
    if not len(long):
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for d in long for w in documents[d]), np.int64, int(sizes[long].sum()))
    # a run holds a factor of eight words twice
    ends = np.repeat(np.cumsum(sizes[long]), sizes[long])
    short = Factors(ids, ends, BASE)
    owner = np.repeat(long, sizes[long])
    if len(short.ranks) <= BASE or not len(short._open):
        return out
    again = np.unique(owner[short.suffixes[short._open]])
    inside = np.isin(owner, again)
    ids, owner = ids[inside], owner[inside]
    ends = np.cumsum(sizes[again])
    begins = np.repeat(ends - sizes[again], sizes[again])
    f = Factors(ids, np.repeat(ends, sizes[again]))
    tree = WaveletTree(f.suffixes)
    pairs = [_candidates(f, tree, begins, level) for level in range(BASE, len(f.ranks))]
    place, period = (np.concatenate(x) for x in zip(*pairs))
    begin, end = _stretch(f, place, period, begins[place])
    kept = end - begin >= np.maximum(MIN_LENGTH, MIN_REPEATS * period)
    begin, end, period = begin[kept], end[kept], period[kept]
    # the same stretch is also found with multiples of its period
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    least = Factors._changes(begin, end)
    for b, e, q in zip(begin[least].tolist(), end[least].tolist(), period[least].tolist()):
        out[owner[b]].append((b - int(begins[b]), e - b, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [w for w, covered in zip(words, np.cumsum(step[:-1]).tolist()) if not covered]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _slices(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of the texts, in parts of about SLICE_WORDS words."""
    part, held = [], 0
    for text in texts:
        part.append(words_of(text.as_py()))
        held += len(part[-1])
        if held >= SLICE_WORDS:
            yield part
            part, held = [], 0
    if part:
        yield part


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", rest: str = "collapsed") -> DataFrame:
    """``docs`` with two more columns: the runs of each text and the text without their repeats.

    ``runs`` is a list of (start, length, period), word numbers from 0, by start, then period; ``rest``
    joins the kept words by one space. Words are runs of characters other than ASCII white space. A
    null or blank text has no runs and an empty rest. Repeated rows stay; columns that have the names
    of the new ones are replaced, all others are kept.
    """
    base = docs.drop(runs, rest)
    place = base.columns.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField(runs, T.ArrayType(T.StructType(
        [T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))), T.StructField(rest, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _slices(batch.column(place)):
                found = find_runs(part)
                left = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(part, found)]
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                piece = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(rows, pa.list_(_RUN)), pa.array(left, pa.string())],
                                                 names=[*batch.schema.names, runs, rest])

    return base.mapInArrow(run, schema)


def strongest_run(runs: str = "runs") -> Column:
    """The run with the greatest ratio of length to period, compared exactly; the first of equals, null if there is none."""
    first = F.try_element_at(runs, F.lit(1))
    return F.aggregate(runs, first, lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where a tenth of the texts get a periodic tail.

    h = crc32(decimal doc_id), g = floor(h / 10). If h % 10 = 0 and a text has n > 0 words, every word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Rows without
    doc_id keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    marked = (docs.withColumn("__g", F.when(h % 10 == 0, F.floor(h / 10)))
              .withColumn("__w", F.when(F.col("__g").isNotNull(), words)).withColumn("__n", F.size("__w").cast("bigint")))
    a = F.expr("__g % __n")
    p = F.expr("1 + (__n - __g % __n) div (3 + __g % 8)")
    tail = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - F.col("__a") - 1),
                       lambda i: F.get("__w", (F.col("__a") + i % F.col("__p")).cast("int")))
    text = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a").cast("int")), tail), " ")
    return (marked.withColumn("__a", F.when(F.col("__n") > 0, a)).withColumn("__p", F.when(F.col("__n") > 0, p))
            .withColumn("text", F.when(F.col("__n") > 0, text).otherwise(F.col("text")))
            .select(*docs.columns))


def op13_periodic_runs(spark, folder: str) -> DataFrame:
    """Runs of all documents with planted periods: their number, the strongest one, digests of all and of the rest."""
    docs = with_planted_periods(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    found = with_runs(docs).withColumn("top", strongest_run())
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
