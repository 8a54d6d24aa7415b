"""Near duplicates by SimHash, found with deletion-variant signatures.

A fingerprint has 64 bits. Fingerprints that differ in at most ``distance`` bits agree on one of
``distance // 2 + 1`` segments up to a single bit. So instead of ``distance + 1`` short exact
segments, the index holds few long ones: each segment is entered once exactly, and once for every
bit position with that bit deleted (a one-wildcard variant). Variants meet in an equality join: two
segments that differ in exactly the deleted bit meet from its two sides, equal segments meet under
the exact key. Every pair that meets is verified on the full fingerprints inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.components import connected_components
from limpid.session import stage

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
HASH_SEED = 42


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64-bit SimHash of a text as a signed number; 0 without words.

    Words are runs of characters other than ASCII white space, with A-Z in lower case; fewer words
    than a shingle form one shingle. A bit is set if more than half of the shingle hashes have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], seed) for s, e in zip(starts, ends[shingle_words - 1:])]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, dtype=">u8")
    for part in range(0, len(values), 65_536):
        octets = values[part:part + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint",
                     shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Add the signed 64-bit fingerprint of each text. Null and blank texts get 0."""
    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return df.withColumn(to, of(F.col(text)))


def near_links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b), a <> b, between the distinct numbers of ``prints`` (fingerprint) at most
    ``distance`` bits apart. Every such pair is found; a pair may be listed twice."""
    width = 64 // (distance // 2 + 1)
    spots = []
    for low in range(0, 64, width):
        size = min(width, 64 - low)
        mask = ((1 << size) - 1) << low
        spots.append((low * 100 + 99, mask, 0))
        spots += [(low * 100 + bit, mask & ~(1 << (low + bit)), 1 << (low + bit)) for bit in range(size)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    index = F.array(*[F.struct(F.lit(k).alias("spot"), F.lit(signed(m)).cast("bigint").alias("mask"),
                               F.lit(signed(d)).cast("bigint").alias("dropped")) for k, m, d in spots])
    variants = (prints.select("fingerprint", F.explode(index).alias("i"))
                .select("fingerprint", "i.spot", F.col("fingerprint").bitwiseAND(F.col("i.mask")).alias("rest"),
                        (F.col("i.dropped") == 0).alias("exact"),
                        (F.col("fingerprint").bitwiseAND(F.col("i.dropped")) != 0).alias("one")))
    zeros = variants.where("exact or not one").select(F.col("fingerprint").alias("a"), "spot", "rest", "exact")
    ones = variants.where("exact or one").select(F.col("fingerprint").alias("b"), "spot", "rest")
    # under an exact key every fingerprint is on both sides, so only one order of a pair counts; both sides are sorted,
    # since Spark sizes the variants like the fingerprints they are made of and would broadcast them from the driver
    return (zeros.join(ones.hint("merge"), ["spot", "rest"])
            .where((~F.col("exact") | (F.col("a") < F.col("b")))
                   & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") != F.col("b")))
            .select("a", "b"))


def group_near_duplicates(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(fingerprint, component_id) for the distinct fingerprints of ``prints`` (doc_id, fingerprint).

    component_id is the smallest non-null doc_id reachable over links. Rows with one fingerprint are
    one node of the graph, so a group of copies costs one row, however large. A component with null
    ids only has a null id.
    """
    nodes = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    joined = connected_components(near_links(nodes.select("fingerprint"), distance))
    placed = nodes.join(joined, nodes["fingerprint"] == joined["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return placed.join(least, "component").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, fingerprint (bigint), text_digest, component_id.

    Null and blank texts have fingerprint 0 and are linked like any other; null ids never become a
    component_id unless a component has no other; repeated rows stay repeated; an empty table gives
    an empty table; further columns of ``docs`` are not read.
    """
    prints = stage(with_fingerprint(docs.select("doc_id", "text"), shingle_words=shingle_words)
                   .select("doc_id", "fingerprint", F.xxhash64("text").alias("text_digest")), "simhash")
    groups = group_near_duplicates(prints, distance)
    return prints.join(groups, "fingerprint").select("doc_id", "fingerprint", "text_digest", "component_id")


def keep_one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """Rows of ``docs`` with one row of every component: the one with the smallest doc_id.

    Rows that share this doc_id are told apart by the hash of the text, smallest first; a null id
    comes after all others. All columns of ``docs`` are returned unchanged.
    """
    members = near_duplicates(docs, shingle_words, distance)
    best = (members.groupBy("component_id")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_digest")).alias("k"))
            .select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_digest").alias("kept_digest")))
    names = docs.columns
    digest = F.xxhash64("text")
    kept = docs.join(best, docs["doc_id"].eqNullSafe(best["kept_id"]) & (digest == best["kept_digest"]), "left_semi")
    marked = kept.withColumn("__digest", F.xxhash64("text"))
    return marked.dropDuplicates(["doc_id", "__digest"]).select(*names)


def op10_simhash_near_dedup(spark, folder: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of all documents."""
    found = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
