"""Exact removal of repeated word windows, partitioned by super-k-mers.

A window is ``window`` consecutive words. Its minimiser is the smallest hash among the runs of
``MINIMISER`` words inside it; consecutive windows that share the occurrence of their minimiser form
one super-k-mer. Equal windows have equal minimisers, so a minimiser is a bucket: only minimisers
that occur in more than one document can hold a repeated window, and only their super-k-mers travel,
each as one packed string, to their bucket. There the windows are cut out and sorted, and equal ones
lie side by side. Hashes only choose buckets; windows are compared as text.

A minimiser with very many occurrences is dealt over several buckets. Each bucket then
reduces its windows to one row per distinct window with the smallest document; these rows meet once
more under the window itself, so a passage that a third of all documents share arrives there as one
row per bucket, not per document. What is found goes back as runs of consecutive windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.session import stage

WINDOW = 50
MINIMISER = 8
# super-k-mers per bucket, before a minimiser is dealt over several buckets
BUCKET_ROWS = 2048
# documents that are written together
PART_ROWS = 1000


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def super_kmers(words: list[bytes], window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[np.ndarray, ...]:
    """(minimiser hash, first window, number of windows) of each super-k-mer of a document."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    size = min(minimiser, window)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        runs = (runs ^ hashed[k:k + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    span = window - size + 1
    # rightmost smallest run in every span, by doubling
    best, width = np.arange(len(runs)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(runs[right] <= runs[left], right, left)
        width += step
    least = runs[best]
    # where the smallest value changes next; an occurrence is kept as long as it lies in the window
    # and is as small as any, so that repeated words do not begin a super-k-mer at every place
    edges = np.append(np.flatnonzero(least[1:] != least[:-1]) + 1, n)
    change = np.repeat(edges, np.diff(np.append(0, edges)))
    firsts, at = [], 0
    while at < n:
        firsts.append(at)
        at = min(int(best[at]) + 1, int(change[at]))
    first = np.array(firsts)
    return least[first].view(np.int64), first, np.diff(np.append(first, n))


def _listed(docs: DataFrame, window: int, minimiser: int) -> DataFrame:
    """(doc_id, digest, minimiser, first, windows), one row per super-k-mer."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, keys, firsts, counts = [], [], [], [], []
            for doc_id, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                key, first, count = super_kmers(words_of(text.as_py()), window, minimiser)
                if len(key):
                    ids.append(np.full(len(key), doc_id, np.int64))
                    digests.append(np.full(len(key), digest, np.int64))
                    keys.append(key)
                    firsts.append(first)
                    counts.append(count)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(np.concatenate(digests)), pa.array(np.concatenate(keys)),
                     pa.array(np.concatenate(firsts).astype(np.int32)),
                     pa.array(np.concatenate(counts).astype(np.int32))],
                    names=["doc_id", "digest", "minimiser", "first", "windows"])

    return docs.mapInArrow(cut, "doc_id bigint, digest bigint, minimiser bigint, first int, windows int")


def _packed(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The wanted super-k-mers with their words: (minimiser, part, parts, doc_id, digest, first, packed)."""
    # a set: copies of one row list the same cuts, and a document's own are bounded by its length
    lists = wanted.groupBy("doc_id", "digest").agg(
        F.collect_set(F.struct("minimiser", "part", "parts", "first", "windows")).alias("cuts"))
    target = pa.schema([("minimiser", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("doc_id", pa.int64()),
                        ("digest", pa.int64()), ("first", pa.int32()), ("packed", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for doc_id, digest, text, cuts in zip(*(batch.column(i) for i in range(4))):
                words = words_of(text.as_py())
                for c in cuts.as_py():
                    packed = b" ".join(words[c["first"]:c["first"] + c["windows"] + window - 1])
                    held += len(packed)
                    rows.append((c["minimiser"], c["part"], c["parts"], doc_id.as_py(), digest.as_py(), c["first"], packed))
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), target)], schema=target)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), target)], schema=target)

    # copies of one row are one document here, so each text is read once
    texts = docs.dropDuplicates(["doc_id", "digest"])
    return (texts.join(lists, ["doc_id", "digest"]).select("doc_id", "digest", "text", "cuts")
            .mapInArrow(cut, "minimiser bigint, part int, parts int, doc_id bigint, digest bigint, first int, packed binary"))


def _cut_windows(rows: list[tuple], window: int) -> list[tuple]:
    """(window, doc_id, digest, place) of the packed strings of one bucket, sorted."""
    cut = []
    for doc_id, digest, first, packed in rows:
        starts = [0]
        at = packed.find(b" ")
        while at >= 0:
            starts.append(at + 1)
            at = packed.find(b" ", at + 1)
        starts.append(len(packed) + 1)
        cut += [(packed[starts[k]:starts[k + window] - 1], doc_id, digest, first + k) for k in range(len(starts) - window)]
    cut.sort()
    return cut


def _runs(places: list[tuple]) -> Iterator[tuple]:
    """(doc_id, digest, first, windows) of consecutive places (doc_id, digest, place)."""
    begun, last = None, None
    for place in sorted(places):
        if last is not None and place[:2] == last[:2] and place[2] <= last[2] + 1:
            last = place
            continue
        if begun is not None:
            yield *begun, last[2] - begun[2] + 1
        begun = last = place
    if begun is not None:
        yield *begun, last[2] - begun[2] + 1


def _equal_windows(cut: list[tuple]) -> Iterator[list[tuple]]:
    k = 0
    while k < len(cut):
        end = k + 1
        while end < len(cut) and cut[end][0] == cut[k][0]:
            end += 1
        yield cut[k:end]
        k = end


_FOUND = "minimiser bigint, part int, window binary, least bigint, docs array<bigint>, digests array<bigint>, firsts array<int>, counts array<int>"
_RUNS = "docs array<bigint>, digests array<bigint>, firsts array<int>, counts array<int>"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def _buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, other columns) of consecutive rows with one key; the first ``width`` columns are the key."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, rows


_LISTS = [("docs", pa.list_(pa.int64())), ("digests", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]


def _counted(packed: DataFrame, window: int) -> DataFrame:
    """Bring the packed strings to their buckets and sort the windows of each.

    A minimiser with one bucket is settled there: one row with the runs to remove. Of a minimiser
    with several, each bucket gives one row per distinct window: its smallest document and all places.
    A task reads its buckets one after the other and holds one of them at a time.
    """
    target = pa.schema([("minimiser", pa.int64()), ("part", pa.int32()), ("window", pa.binary()), ("least", pa.int64()), *_LISTS])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (minimiser, part, parts), rows in _buckets(batches, 3):
            groups = _equal_windows(_cut_windows(rows, window))
            if parts > 1:
                for same in groups:
                    _, docs, digests, firsts = map(list, zip(*same))
                    yield minimiser, part, same[0][0], docs[0], docs, digests, firsts, None
            else:
                # the first of equal windows has the smallest document
                later = [c[1:] for same in groups if len(same) > 1 for c in same if c[1] > same[0][1]]
                if later:
                    yield minimiser, part, None, None, *map(list, zip(*_runs(later)))

    ordered = packed.repartition("minimiser", "part").sortWithinPartitions("minimiser", "part")
    return ordered.mapInArrow(lambda batches: _batches(found(batches), target), _FOUND)


def _settled(met: DataFrame) -> DataFrame:
    """Runs to remove, per bucket of a minimiser with several, once the smallest document is known."""
    target = pa.schema(_LISTS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows in _buckets(batches, 2):
            later = [place for least, *lists in rows for place in zip(*lists) if place[0] > least]
            if later:
                yield tuple(map(list, zip(*_runs(later))))

    ordered = (met.select("minimiser", "part", "overall", "docs", "digests", "firsts")
               .repartition("minimiser", "part").sortWithinPartitions("minimiser", "part"))
    return ordered.mapInArrow(lambda batches: _batches(found(batches), target, 50), _RUNS)


def repeated_windows(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """(doc_id, digest, first, windows): runs of windows whose words also start in a document with a smaller doc_id.

    digest is the hash of the whole text; with doc_id it names a row, also where ids repeat. A run
    has ``windows`` windows, the first of them at word ``first``.
    """
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("digest"), "text")
    listed = stage(_listed(docs, window, minimiser), "super-kmers")
    # staged, so that the join below has two plain inputs and Spark can split a hot minimiser
    shared = stage(listed.groupBy("minimiser").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                   .where("least < most")
                   .select("minimiser", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts")), "minimisers")
    wanted = listed.join(shared, "minimiser").withColumn("part", F.pmod(F.xxhash64("doc_id", "first"), F.col("parts")).cast("int"))
    found = stage(_counted(_packed(docs, wanted, window), window), "window-counts")
    met = found.where("window is not null")
    least = met.groupBy("window").agg(F.min("least").alias("overall"))
    runs = found.where("window is null").select("docs", "digests", "firsts", "counts").union(_settled(met.join(least, "window")))
    return runs.select(F.explode(F.arrays_zip("docs", "digests", "firsts", "counts")).alias("at")).select(
        F.col("at.docs").alias("doc_id"), F.col("at.digests").alias("digest"), F.col("at.firsts").alias("first"), F.col("at.counts").alias("windows"))


def _rest(docs: DataFrame, repeated: DataFrame, window: int, schema: str, finish) -> DataFrame:
    """Apply ``finish(words, keep mask, text)`` to each document; its columns follow those of ``docs``."""
    lists = (repeated.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("first", "windows")).alias("__runs"))
             .withColumnsRenamed({"doc_id": "__of", "digest": "__digest"}))
    same = (docs["doc_id"] == F.col("__of")) & (F.xxhash64(docs["text"]) == F.col("__digest"))
    joined = docs.join(lists, same, "left").drop("__of", "__digest")
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a part of a batch at a time, so that the new texts of a whole one do not wait beside the old ones
        for batch in (whole.slice(at, PART_ROWS) for whole in batches for at in range(0, whole.num_rows, PART_ROWS)):
            made = []
            for text, runs in zip(batch.column(place), batch.column(len(names))):
                words = words_of(text.as_py())
                step = np.zeros(len(words) + 1, np.int64)
                for run in runs.as_py() or ():
                    step[run["first"]] += 1
                    step[run["first"] + run["windows"] + window - 1] -= 1
                made.append(finish(words, np.cumsum(step[:-1]) == 0, text.as_py()))
            yield finish.batch(batch, made, place, len(names))

    return joined.mapInArrow(run, schema)


class _Counts:
    """Numbers of words and the digest of what is left."""

    def __call__(self, words, keep, text):
        left = [w for w, k in zip(words, keep.tolist()) if k]
        return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()

    def batch(self, batch, made, place, width):
        n, removed, digest = zip(*made) if made else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])


class _Texts:
    """The kept words, joined by one space where something was removed; other texts stay as they are."""

    def __call__(self, words, keep, text):
        if keep.all():
            return text
        return b" ".join(w for w, k in zip(words, keep.tolist()) if k).decode("utf-8", "surrogatepass")

    def batch(self, batch, made, place, width):
        columns = [batch.column(i) for i in range(width)]
        columns[place] = pa.array(made, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])


def removal_counts(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ...): doc_id, n_words, n_removed, kept_sha256.

    A null text has no words. Rows without doc_id keep all their words and remove none elsewhere.
    Rows that repeat a doc_id keep what they share with each other. Other columns are not read.
    """
    narrow = docs.select("doc_id", "text")
    return _rest(narrow, repeated_windows(narrow, window, minimiser), window,
                 "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", _Counts())


def without_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """``docs`` with the repeated words cut from ``text``; all columns and rows stay.

    Texts that lose nothing are unchanged; others become their kept words joined by one space.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    return _rest(docs, repeated_windows(docs, window, minimiser), window, schema, _Texts())


def op9_substring_dedup(spark, folder: str) -> DataFrame:
    """Numbers of words, removed words and the digest of the kept ones, for all documents."""
    return removal_counts(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
