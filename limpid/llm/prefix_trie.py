"""Prefix trie of conversations, rolled up by depth bands.

Every distinct sequence of first turns is a node. A node is known by the exclusive-or of the hashes
of (place, turn) along its path, so a path of any length is cut into blocks that are hashed apart and
joined by their totals; that equal keys mean equal paths is checked while the nodes are counted.

Totals over subtrees need neither one round per level nor one row per ancestor. Depths are cut into
bands of ``band`` levels. Inside a band a node explodes to its ancestors down to the top of the band,
at most ``band`` rows. The tops of the bands form a tree that is ``band`` times lower; it is rolled up
the same way, and its completed totals then go to the ancestors of each top in the band above. Rounds
grow with the logarithm of the depth to the base ``band``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpid.session import stage

BAND = 16
# turns of one conversation whose hashes are joined in one group
BLOCK = 4096
# characters of ids that travel as one cell
CHUNK = 65_536
NO_ENDS = hashlib.sha256(b"").hexdigest()

_ROOT = "named_struct('a', 0L, 'b', 0L)"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes) of ``conversations`` (conv_id, turn, role, text); places from 1.

    Turns are ordered by turn, null first, ties by the digest of role and text; null role or text is
    empty. Rows without conv_id belong to no conversation and are left out; repeated rows are turns of
    their own; other columns are not read. Rows are numbered in ranges of (conv_id, turn), so a
    conversation with very many turns is numbered by many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = stage(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes")), "turns")
    ranged = stage(turns.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "turn-ranges")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("conv_id").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a range can begin in an earlier one: at most one row per range
    begun = counts.withColumn("before", F.sum("n").over(earlier)).where("before is not null").select("conv_id", "part", "before")
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return (ranged.withColumn("__row", F.row_number().over(within))
            .join(F.broadcast(begun), ["conv_id", "part"], "left")
            .select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("__row")).cast("bigint").alias("place"), "digest", "bytes"))


def _paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, mark, bytes) of every turn: the key of its prefix and the hash of the turn itself."""
    marked = turns.select("conv_id", F.col("place").alias("depth"), "bytes", F.expr(f"(place - 1) div {BLOCK}").alias("block"),
                          F.struct(F.xxhash64(F.lit(1), "place", "digest").alias("a"),
                                   F.xxhash64(F.lit(2), "place", "digest").alias("b")).alias("mark"))
    joined = lambda w: F.struct(*[F.expr(f"bit_xor(mark.{c})").over(w).alias(c) for c in "ab"])
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    blocks = stage(marked.withColumn("key", joined(within)), "blocks")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (blocks.groupBy("conv_id", "block").agg(F.struct(*[F.expr(f"bit_xor(mark.{c})").alias(c) for c in "ab"]).alias("mark"))
              .withColumn("before", joined(earlier)).where("block > 0").select("conv_id", "block", "before"))
    later = blocks.where("block > 0").join(before, ["conv_id", "block"]).withColumn(
        "key", F.struct(*[F.col(f"key.{c}").bitwiseXOR(F.col(f"before.{c}")).alias(c) for c in "ab"]))
    columns = ["conv_id", "depth", "key", "mark", "bytes"]
    return stage(blocks.where("block = 0").select(*columns).union(later.select(*columns)), "paths")


def _with_ancestors(paths: DataFrame, band: int) -> DataFrame:
    """Add ``above``: the keys from the top of the band above ``depth`` down to the parent, at most ``band``."""
    # the lowest level of a band is the top of the next one and enters there as well
    places = F.expr(f"if(depth % {band} = 0, array((depth - 1) div {band}, depth div {band}), array((depth - 1) div {band}))")
    rows = paths.withColumn("__band", F.explode(places))
    before = Window.partitionBy("conv_id", "__band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    listed = rows.withColumn("__list", F.collect_list("key").over(before)).where(f"__band = (depth - 1) div {band}")
    above = F.when(F.col("__band") == 0, F.concat(F.array(F.expr(_ROOT)), F.col("__list"))).otherwise(F.col("__list"))
    return listed.withColumn("above", above).drop("__band", "__list")


def _sums(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy("key").agg(*[F.sum(n).alias(n) for n in names])


def _rolled(items: DataFrame, paths: DataFrame, names: list[str], band: int) -> DataFrame:
    """(key, *names): sums of ``names`` over the subtree of each item (key, depth, above, *names)."""
    lowest = items.agg(F.max("depth")).first()[0] or 0
    # nodes inside a band count for themselves and their ancestors in it; tops count for themselves
    inside = F.when(F.col("depth") % band == 0, F.array("key")).otherwise(F.concat("above", F.array("key")))
    partial = stage(_sums(items.select(F.explode(inside).alias("key"), *names), names), "band-sums")
    if lowest < band:
        return partial
    tops = items.where(F.col("depth") % band == 0).select("key", (F.expr(f"depth div {band}")).alias("depth"), "above")
    lifted = paths.where(F.col("depth") % band == 0).select("conv_id", F.expr(f"depth div {band}").alias("depth"), "key")
    over = _with_ancestors(lifted, band).groupBy("key").agg(F.first("above").alias("above"))
    root = F.expr("array()").cast("array<struct<a:bigint,b:bigint>>")
    higher = stage(tops.drop("above").join(over, "key", "left").withColumn("above", F.coalesce("above", root)).join(partial, "key"), "band-tops")
    done = _rolled(higher, lifted, names, band)
    finished = stage(tops.where("depth > 0").join(done, "key"), "band-totals")
    # a completed top counts for its ancestors in the band above, but for the top of that band
    sent = finished.select(F.explode(F.expr("slice(above, 2, size(above))")).alias("key"), *names)
    middle = partial.join(tops.select("key"), "key", "left_anti").unionByName(sent)
    return stage(_sums(middle, names).unionByName(done), "totals")


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): digest of the ascending ids of each key, comma-joined.

    Ids are sorted in ranges and packed into chunks of text; the chunks of a key are then hashed one
    after another. The digest of a text is sequential by definition, so the chunks of one key pass
    through one task, as a stream.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, made = None, [], 0, []
        for batch in batches:
            for a, b, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (a, b) or size > CHUNK:
                    if ids:
                        made.append((*key, int(ids[0]), ",".join(ids)))
                    key, ids, size = (a, b), [], 0
                ids.append(str(conv_id))
                size += len(ids[-1]) + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["a", "b", "least", "ids"])
                made = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, int(ids[0]), ",".join(ids))], names=["a", "b", "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (a, b):
                    if key is not None:
                        made.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["a", "b", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=["a", "b", "ends_sha256"])

    flat = ends.select("key.a", "key.b", "conv_id")
    chunks = stage(flat.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
                   .mapInArrow(pack, "a bigint, b bigint, least bigint, ids string"), "end-chunks")
    return (chunks.repartition("a", "b").sortWithinPartitions("a", "b", "least")
            .mapInArrow(digest, "a bigint, b bigint, ends_sha256 string"))


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, band: int = BAND) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place, digest, bytes; places from 1, gapless).

    ``members`` (conv_id) lists conversations that have no turn besides those of ``turns``; they end
    at the root. Columns: key, parent (null at the root), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without any
    conversation there is no node. Copies of a conversation, however many, are one path of nodes from
    the first grouping on.
    """
    paths = _paths(turns)
    listed = _with_ancestors(paths, band).select("conv_id", "depth", "key", "mark", "bytes", "above")
    everyone = paths.select("conv_id")
    everyone = (everyone if members is None else everyone.union(members.select("conv_id"))).distinct()
    starts = everyone.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.expr(_ROOT).alias("key"), F.expr(_ROOT).alias("mark"),
                             F.lit(0).cast("bigint").alias("bytes"),
                             F.expr("array()").cast("array<struct<a:bigint,b:bigint>>").alias("above"))
    # equal keys are equal paths if they agree in depth, last turn and the key above; checked, not assumed
    parent = F.try_element_at("above", F.lit(-1))
    same = lambda c: F.min(c).eqNullSafe(F.max(c))
    counted = listed.unionByName(starts).groupBy("key").agg(
        F.count("conv_id").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"),
        F.first("above").alias("above"), F.max(parent).alias("parent"), (same("depth") & same("mark") & same("bytes") & same(parent)).alias("same"))
    nodes = stage(counted.withColumn("n_convs", F.when(F.col("same"), F.col("n_convs")).otherwise(
        F.raise_error(F.lit("two different conversation prefixes have one key")).cast("bigint"))).drop("same"), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("depth").alias("n_children"))
    weighed = stage(nodes.join(children, "key", "left").select(
        "key", "depth", "above", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "weights")
    totals = _rolled(weighed.drop("n_children"), paths, ["n_leaves", "saved_tokens"], band)
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("last")).select("conv_id", "last.key")
    ends = last if members is None else last.unionByName(everyone.join(last, "conv_id", "left_anti").select("conv_id", F.expr(_ROOT).alias("key")))
    digests = _ends_digest(ends).select(F.struct("a", "b").alias("key"), "ends_sha256")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.select("key", "parent", "conv_id", "depth", "n_convs")
            .join(weighed.select("key", "n_children"), "key").join(totals, "key")
            .join(digests, "key", "left").join(above, "parent", "left")
            .select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """``prefix_trie`` of the turns of ``conversations`` (conv_id, turn, role, text), as ``numbered_turns`` orders them."""
    return prefix_trie(numbered_turns(conversations), band=band)


def trie_turns(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """Every shared turn once: (conv_id, depth, parent_conv_id, n_convs, role, text), a row per node but the root.

    A conversation is the chain of rows from its last turn upwards; role and text are those of the
    smallest member, with null as empty.
    """
    nodes = conversation_trie(conversations, band).where("depth > 0")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    texts = (conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), digest.alias("digest"),
                                                               role.alias("role"), text.alias("text"))
             .dropDuplicates(["conv_id", "digest"]))
    places = numbered_turns(conversations).select("conv_id", F.col("place").alias("depth"), "digest")
    return (nodes.select("conv_id", "depth", "parent_conv_id", "n_convs").join(places, ["conv_id", "depth"])
            .join(texts, ["conv_id", "digest"]).drop("digest"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members of conversations that borrow their first turns.

    Every conversation c begins with the first h turns of conversation c - c % 5 (all of them if there
    are fewer, none if it is absent) and goes on with its own turns after its first h;
    h = crc32(decimal c) % 9. The rest of a negative id is taken towards zero below, so that groups of
    five ids begin at multiples of five.
    """
    turns = stage(numbered_turns(conversations), "numbered")
    base = F.expr("conv_id - pmod(conv_id, 5)")
    borrowed = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("bigint")
    members = stage(turns.select("conv_id").distinct().withColumn("base", base).withColumn("h", borrowed), "members")
    heads = turns.where("pmod(conv_id, 5) = 0 and place <= 8")
    lengths = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("place").alias("n"))
    # how far a conversation's own turns move: fewer turns may be borrowed than are cut
    moved = (members.where("conv_id <> base").join(lengths, "base", "left")
             .select("conv_id", "h", (F.least("h", F.coalesce("n", F.lit(0))) - F.col("h")).alias("shift")))
    own = (turns.where("pmod(conv_id, 5) <> 0").join(moved, "conv_id").where("place > h")
           .select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "digest", "bytes"))
    copied = (heads.withColumnRenamed("conv_id", "base").join(members.where("conv_id <> base"), "base").where("place <= h")
              .select("conv_id", "place", "digest", "bytes"))
    whole = turns.where("pmod(conv_id, 5) = 0")
    return stage(whole.unionByName(own).unionByName(copied), "rebuilt"), members.select("conv_id")


def op11_prefix_trie(spark, folder: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    turns, members = rebuilt_turns(spark.read.parquet(f"{folder}/conversations.parquet"))
    return prefix_trie(turns, members).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {"op11_prefix_trie": op11_prefix_trie}

# crc32 of a decimal number: eight steps for each of its characters
_CRC = """(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [(ascii(c) + 8589934592)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda r, s: CASE WHEN s >= 0 THEN xor(r, s - 8589934592) WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END))"""

SQL = {"op11_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
    {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
members AS (SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base, xor({_CRC}, 4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
lists AS (SELECT conv_id, list(said ORDER BY place) AS said FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT m.conv_id, list_concat(coalesce(b.said[1:m.h], []), o.said[m.h + 1:]) AS said
  FROM members m JOIN lists o ON o.conv_id = m.conv_id LEFT JOIN lists b ON b.conv_id = m.base),
prefixes AS (SELECT conv_id, len(said) AS n, d, said[1:d] AS path FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
weights AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS leaf,
    (n_convs - 1) * coalesce(strlen(nodes.path[depth].t), 0) AS saved
  FROM nodes LEFT JOIN children ON nodes.path = children.path),
totals AS (
  SELECT path[1:d] AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, leaf, saved, unnest(range(depth + 1)) AS d FROM weights) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, t.n_leaves::BIGINT AS n_leaves,
  t.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM weights w JOIN totals t ON t.path = w.path LEFT JOIN nodes p ON w.depth > 0 AND p.path = w.path[1:w.depth - 1]"""}
