"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily: as long as something fits, the longest piece that fits goes in. Then the
bin's smallest piece is taken back, and if two unpacked pieces fill the widened gap more tightly than
it did, they replace it. Lengths are small numbers, so pieces wait in a queue per length, and a bin
needs a few lookups in a table of lengths instead of a search through pieces.

Pieces are dealt at random over groups of bounded size, each packed by one task: a group has enough
short pieces to fill its gaps, and leaves at most one poorly filled bin. Full-length pieces are bins
of their own.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise, repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.session import stage

SEQUENCE = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
# pieces packed together by one task
GROUP_PIECES = 20_000
# bytes of texts that are tokenised together
PART_OCTETS = 4_000_000
# units that go through the model in one call
CALL_UNITS = 20_000
# distinct words whose ids a task remembers
REMEMBERED = 500_000

# fixed values: how the vocabulary's own file splits text of Latin letters and ASCII signs into units
_LATIN = "a-z\u00df-\u00f6\u00f8-\u00ff"
_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
_PLAIN = re.compile(f"[!-~{_LATIN}\u00c0-\u00d6\u00d8-\u00de]+")


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins over white space.

    Texts are cut at ASCII white space side by side, so that Python sees only the distinct words of a part,
    and every distinct word is encoded once. Words of Latin letters
    and ASCII signs go through the vocabulary's model unit by unit; all others through the whole
    tokenizer. A full memory is emptied, which costs time and changes nothing. With ``added_tokens``,
    texts that hold an added token of the file go through the file's tokenizer as it stands.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, added_tokens: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.untouched = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.untouched.get_added_tokens_decoder().values()] if added_tokens else []
        # the vocabulary's model alone, which takes units as they are
        self.by_unit = Tokenizer(self.whole.model)
        # the last id of a unit, and no other, has the mark of its end
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(self.whole.model.end_of_word_suffix)]] = True
        octets = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: octets.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.remembered = remembered
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.units: dict[str, bytes] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.starts = np.zeros(self.remembered + 1, np.int64)

    def _units_of(self, word: bytes, text: str, low: str) -> list[str] | str | None:
        """Units of a word, its only one as it is, or None if only the whole tokenizer can tell."""
        if word.isalpha():  # ASCII letters alone are one unit
            return low
        if not _PLAIN.fullmatch(text):
            return None
        if low.isalpha():
            return low
        if low[:-1].isalpha() and not low[-1].isalnum():  # a word and a sign are two units
            return [low[:-1], low[-1]]
        return _UNITS.findall(low)

    def _learn_units(self, units: list[str]) -> None:
        """Ids of units that are not known yet, as octets, many in one call of the model."""
        for at in range(0, len(units), CALL_UNITS):
            part = units[at:at + CALL_UNITS]
            listed = [u if u.isascii() else u.translate(self.letters) for u in part]
            ids = np.array(self.by_unit.encode_batch_fast([listed], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            octets = ids.tobytes()
            self.units.update(zip(part, [octets[a:b] for a, b in pairwise([0, *ends])], strict=True))

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as octets: such values cost the collector of garbage nothing."""
        joined = b"\n".join(words).decode("utf-8", "replace")
        texts, known = joined.split("\n"), self.units
        split = [self._units_of(*w) for w in zip(words, texts, joined.lower().split("\n"))]
        fresh = {u for u in split if u.__class__ is str}
        fresh.update(chain.from_iterable(u for u in split if u.__class__ is list))
        self._learn_units([u for u in fresh if u not in known])
        return [known[units] if units.__class__ is str else b"".join(map(known.__getitem__, units)) if units is not None
                else np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes() for text, units in zip(texts, split)]

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of distinct words are; words that are not known yet are learned."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        if len(self.place) + len(missing) > self.remembered:
            self._clear()
            missing = np.arange(len(words))
            if len(words) > self.remembered:
                self.starts = np.zeros(len(words) + 1, np.int64)
        fresh = words if len(missing) == len(words) else [words[k] for k in missing.tolist()]
        ids = self._of_words(fresh)
        known, end = len(self.place), int(self.starts[len(self.place)])
        ends = end + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[end:ends[-1]] = np.frombuffer(b"".join(ids), np.uint32)
        self.starts[known + 1:known + 1 + len(fresh)] = ends
        self.place.update(zip(fresh, range(known, known + len(fresh))))
        at[missing] = np.arange(known, known + len(fresh))
        return at

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([(text or "").encode("utf-8", "replace")], pa.binary()).cast(pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); a null text has none."""
        texts = texts.fill_null("")
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token.decode()).to_numpy(zero_copy_only=False)
        if special.any():
            parts = [np.array(self.untouched.encode(t.as_py(), add_special_tokens=False).ids, np.uint32) if own else self.encode_all(pa.array([t.as_py()], pa.string()))[0]
                     for t, own in zip(texts, special.tolist())]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        # lower case first saves distinct words; combining marks could make a difference, so not with them
        octets = texts.cast(pa.binary())
        marked = pc.or_(pc.match_substring(octets, b"\xcc"), pc.match_substring(octets, b"\xcd"))
        split = pc.ascii_split_whitespace(pc.if_else(marked, texts, pc.ascii_lower(texts)))
        found = split.flatten().dictionary_encode()
        # no word holds a line break; blank texts and the ends of others give empty words, which have no ids
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary), "\n")
        words = joined.cast(pa.binary())[0].as_py().split(b"\n") if len(found) else []
        at = self._places(words)[found.indices.to_numpy()] if words else np.empty(0, np.int64)
        first = self.starts[at]
        size = self.starts[at + 1] - first
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        return ids, np.diff(before[np.concatenate([[0], ends])])


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker; it lives on between the worker's tasks."""
    # a task has one core: threads of the library would only wait for work
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    state = sys.modules.setdefault("limpid_worker_state", ModuleType("limpid_worker_state"))
    held = state.__dict__.setdefault("tokenizers", {})
    if path not in held:
        held[path] = WordTokenizer(path, added_tokens=True)
    return held[path]


def tokenised_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
                     with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents as ids and an end id, cut if longer."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    target = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                # as many texts as fill a part, one at least
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_OCTETS, side="right")))
                yield cut(batch.column(0)[at:end], *tokenizer.encode_all(batch.column(1)[at:end]))
                at = end

    def cut(doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        sizes = sizes + 1
        ends = np.cumsum(sizes)
        whole = np.full(ends[-1], end_id, "<u4")
        inner = np.ones(len(whole), bool)
        inner[ends - 1] = False
        whole[inner] = ids
        number = -(-sizes // sequence)
        doc = np.repeat(np.arange(len(sizes)), number)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
        start = piece * sequence
        length = np.minimum(sizes[doc] - start, sequence)
        edges = np.append(0, np.cumsum(length))
        octets = memoryview(whole).cast("B")
        sums = [zlib.crc32(octets[4 * a:4 * b]) for a, b in pairwise(edges.tolist())]
        columns = [doc_ids.take(pa.array(doc)), piece, start, length, sums]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(whole.astype(np.int32))))
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths are 1 to ``sequence``."""
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=sequence + 1)[:sequence + 1]
    tail = np.cumsum(left)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    # longest waiting length up to x, for every x
    longest = np.maximum.accumulate(np.where(left > 0, np.arange(sequence + 1), 0))

    def taken(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            below = longest[size - 1]
            stop = size + 1
            while stop <= sequence and longest[stop] == size:
                stop += 1
            longest[size:stop] = below

    def put_back(size: int) -> None:
        left[size] += 1
        if left[size] == 1:
            stop = size
            while stop <= sequence and longest[stop] < size:
                longest[stop] = size
                stop += 1

    number = 0
    while longest[sequence]:
        inside, gap = [], sequence
        while gap and longest[gap]:
            size = int(longest[gap])
            taken(size)
            inside.append(size)
            gap -= size
        if gap and len(inside) > 1 and longest[sequence]:
            smallest = inside.pop()
            room = gap + smallest
            a = np.flatnonzero(left[:room] > 0)
            # the partner of each length: the longest that fits beside it, another piece if equal
            b = longest[room - a]
            b = np.where((b == a) & (left[a] < 2), longest[np.maximum(a - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            k = int(np.argmax(both)) if len(both) else 0
            if len(both) and both[k] > smallest:
                put_back(smallest)
                taken(int(a[k]))
                taken(int(b[k]))
                inside += [int(a[k]), int(b[k])]
            else:
                inside.append(smallest)
        at = 0
        for size in inside:
            tail[size] -= 1
            piece = order[tail[size]]
            bins[piece], offsets[piece] = number, at
            at += size
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    Pieces are dealt over groups by a hash of id, piece, the rest of the row and its place in the
    table, so equal rows spread as well; the number of groups follows the number of pieces, so a group never
    grows with the table.
    """
    short = pieces.where(F.col("length") < sequence).count()
    groups = max(1, -(-short // group_pieces))
    mixed = F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id bigint, offset bigint"
    # groups use the upper part of the number, full pieces a number of their own below zero
    full = (pieces.where(F.col("length") == sequence)
            .withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint")))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.drop_columns(["__group"]).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        number, offset = best_two_fit(group["length"].to_numpy(), sequence)
        return (group.append_column("sequence_id", pa.array((key[0].as_py() << 32) + number))
                .append_column("offset", pa.array(offset)))

    dealt = pieces.where(F.col("length") < sequence).withColumn("__group", F.pmod(mixed, F.lit(groups)))
    return full.unionByName(dealt.groupBy("__group").applyInArrow(run, schema))


def packed_documents(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
                     group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Every document of ``docs`` (doc_id, text, ...) in sequences: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset, and the ids if wanted.

    A null or empty text is the end id alone. Null ids and repeated rows are packed like others. Only
    documents longer than a sequence are cut. An empty table gives no sequences. Other columns are
    not read. ``path`` is the tokenizer file on the executors.
    """
    return pack(stage(tokenised_pieces(docs, path, sequence, end_id, with_ids), "pieces"), sequence, group_pieces)


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packed_documents(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary_path())


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
