"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt over shards of bounded size. Each shard's graph is a set of flat arrays:
unit vectors, and per layer one array of neighbour numbers with a fixed width. Nodes are numbered by
falling level, so a layer holds the first nodes and needs no map of its own. The graphs are written to
the shared folder; blocks of queries then meet every shard, and the results of the shards are merged.

Building and searching work on many nodes at once: a batch of searches advances together, each with
its own beam, so every step is one gather, one product and one selection in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limpid.session import stage

NEAREST = 5
LINKS = 16
BUILD_BEAM = 96
SEARCH_BEAM = 128
SHARD_ROWS = 8_192
QUERY_BLOCK = 512
QUERY_EVERY = 50
_BATCH = 256
_EXPAND = 4


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.sqrt((wide ** 2).sum(axis=1, keepdims=True))).astype(np.float32)


def beam_search(units: np.ndarray, links: np.ndarray, asked: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the best ``beam`` nodes found for each asked row, best first; -1 where none.

    ``entries`` (rows, k) are starting nodes, -1 for none; ``links`` (nodes, width) the layer.
    """
    rows, width = len(asked), links.shape[1]
    seen = np.zeros((rows, len(links) + 1), bool)
    seen[:, -1] = True  # -1 is never visited
    every = np.arange(rows)
    nodes = np.full((rows, beam), -1, np.int64)
    score = np.full((rows, beam), -np.inf, np.float32)
    done = np.ones((rows, beam), bool)
    starts = entries[:, :beam]
    nodes[:, :starts.shape[1]] = starts
    score[:, :starts.shape[1]] = np.where(starts >= 0, np.einsum("bkd,bd->bk", units[starts], asked), -np.inf)
    done[:, :starts.shape[1]] = starts < 0
    seen[every[:, None], starts] = True
    active = every
    while len(active):
        waiting = np.where(done[active], -np.inf, score[active])
        take = min(_EXPAND, beam)
        best = np.argpartition(-waiting, take - 1, axis=1)[:, :take]
        chosen = np.take_along_axis(waiting, best, axis=1) > -np.inf
        open_rows = chosen.any(axis=1)
        active, best, chosen = active[open_rows], best[open_rows], chosen[open_rows]
        if not len(active):
            break
        done[active[:, None], best] = True
        at = np.where(chosen, nodes[active[:, None], best], -1)
        found = np.where((at >= 0)[:, :, None], links[at], -1).reshape(len(active), take * width)
        fresh = ~seen[active[:, None], found]
        seen[active[:, None], found] = True
        found = np.where(fresh, found, -1)
        # the same node may come from two expanded nodes; only one copy stays
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        near = np.where(found >= 0, np.einsum("bkd,bd->bk", units[found], asked[active]), -np.inf)
        all_nodes = np.concatenate([nodes[active], found], axis=1)
        all_score = np.concatenate([score[active], near], axis=1)
        all_done = np.concatenate([done[active], found < 0], axis=1)
        kept = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, kept, axis=1)
        score[active] = np.take_along_axis(all_score, kept, axis=1)
        done[active] = np.take_along_axis(all_done, kept, axis=1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(score, order, axis=1)


def select_links(units: np.ndarray, nodes: np.ndarray, score: np.ndarray, limit: int) -> np.ndarray:
    """Up to ``limit`` of each row's candidates (best first, -1 for none): one is taken if it is nearer
    to the row's own vector than to all taken before; free places go to the best of the others."""
    rows, width = nodes.shape
    near = units[nodes]
    between = np.matmul(near, near.transpose(0, 2, 1))
    taken = np.zeros((rows, width), bool)
    count = np.zeros(rows, np.int64)
    for j in range(width):
        closest = np.where(taken, between[:, j, :], -np.inf).max(axis=1)
        good = (nodes[:, j] >= 0) & (count < limit) & (score[:, j] > closest)
        taken[:, j] = good
        count += good
    rank = np.where(taken, 0, np.where(nodes >= 0, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :limit]
    out = np.take_along_axis(nodes, order, axis=1)
    if out.shape[1] < limit:
        out = np.concatenate([out, np.full((rows, limit - out.shape[1]), -1, out.dtype)], axis=1)
    return out


def _add_back(units: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Enter the new nodes at their neighbours; a full list keeps its best links."""
    width = links.shape[1]
    to, fro = chosen.ravel(), np.repeat(new, chosen.shape[1])
    to, fro = to[to >= 0], fro[to >= 0]
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, fro = to[order], fro[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    extra = np.full((len(targets), counts.max()), -1, np.int64)
    extra[np.repeat(np.arange(len(targets)), counts), np.arange(len(to)) - np.repeat(first, counts)] = fro
    both = np.concatenate([links[targets], extra], axis=1)
    score = np.where(both >= 0, np.einsum("bkd,bd->bk", units[both], units[targets]), -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    both, score = np.take_along_axis(both, order, axis=1), np.take_along_axis(score, order, axis=1)
    full = (both >= 0).sum(axis=1) > width
    links[targets[~full]] = both[~full][:, :width]
    for part in range(0, int(full.sum()), 512):
        rows = np.flatnonzero(full)[part:part + 512]
        links[targets[rows]] = select_links(units, both[rows], score[rows], width)


def build_graph(units: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 11) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, layers): node k is row order[k]; layers[0] holds all nodes, later ones the first few."""
    n = len(units)
    level = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
    order = np.argsort(-level, kind="stable")
    level, units = level[order], units[order]
    layers = [np.full((int((level >= k).sum()), links * (2 if k == 0 else 1)), -1, np.int64) for k in range(level[0] + 1 if n else 0)]
    done = 0
    while done < n:
        size = min(_BATCH, max(1, done // 2), int((level == level[done]).sum() - (done - (level > level[done]).sum())))
        new = np.arange(done, done + size)
        own = int(level[done])
        entry = np.zeros((size, 1), np.int64) if done else np.full((size, 1), -1, np.int64)
        for k in range(len(layers) - 1, own, -1):
            entry = beam_search(units, layers[k], units[new], entry, 1)[0]
        among = units[new] @ units[new].T
        np.fill_diagonal(among, -np.inf)
        mates = np.argsort(-among, axis=1)[:, :links]
        mate_score = np.take_along_axis(among, mates, axis=1)
        mate_nodes = np.where(np.isfinite(mate_score), new[mates], -1)
        for k in range(own, -1, -1):
            nodes, score = beam_search(units, layers[k], units[new], entry, beam)
            entry = nodes[:, :links]
            nodes, score = np.concatenate([nodes, mate_nodes], axis=1), np.concatenate([score, mate_score], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            nodes, score = np.take_along_axis(nodes, best, axis=1), np.take_along_axis(score, best, axis=1)
            chosen = select_links(units, nodes, score, links)
            layers[k][new, :links] = chosen
            _add_back(units, layers[k], new, chosen)
        done += size
    return order, layers


def search_graph(units: np.ndarray, layers: list[np.ndarray], asked: np.ndarray, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), best first, of the nearest nodes found; ``units`` in the graph's order."""
    entry = np.zeros((len(asked), 1), np.int64)
    for layer in reversed(layers[1:]):
        entry = beam_search(units, layer, asked, entry, 1)[0]
    return beam_search(units, layers[0], asked, entry, beam)


_INDEX = "dims int, shard int, vectors binary, sizes array<int>, members binary, layers array<binary>, widths array<int>"


def build_index(vectors: DataFrame, keep: int = NEAREST + 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard with the flat arrays of its graph; ``vectors`` has vec_id and embedding.

    Equal vectors are one node that lists its ``keep`` smallest ids: a search for fewer neighbours
    never needs more of them, and a vector that a third of all rows share costs one node. Vectors of
    different lengths go to different shards.
    """
    first = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = (usable(vectors).select("vec_id", "embedding").distinct()
             .withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
             .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    nodes = stage(nodes.withColumn("dims", F.size("embedding")), "distinct-vectors")
    counts = {r[0]: r[1] for r in nodes.groupBy("dims").count().collect()}
    shards = F.coalesce(*[F.when(F.col("dims") == d, F.lit(-(-n // shard_rows))) for d, n in counts.items()], F.lit(1))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), shards).cast("int"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("ids", key=lambda s: s.str[0], kind="stable", ignore_index=True)
        vectors = np.stack(rows["embedding"].tolist()).astype(np.float32)
        order, layers = build_graph(unit_rows(vectors))
        ids = [rows["ids"][k] for k in order]
        return pd.DataFrame([(key[0], key[1], vectors[order].tobytes(), [len(x) for x in ids], np.concatenate(ids).astype(np.int64).tobytes(),
                              [x.astype(np.int32).tobytes() for x in layers], [x.shape[1] for x in layers])],
                            columns=["dims", "shard", "vectors", "sizes", "members", "layers", "widths"])

    return stage(dealt.groupBy("dims", "shard").applyInPandas(build, _INDEX), "graph-index")


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite numbers that are not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = F.col("embedding")
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(
        F.forall(e, finite) & F.exists(e, lambda x: x != 0), F.lit(False)))


def nearest(queries: DataFrame, index: DataFrame, k: int = NEAREST, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of up to ``k`` neighbours of each row of ``queries`` (vec_id, embedding).

    Rows with the query's own id are not its neighbours. score is the cosine in double precision;
    ties go to the smaller id. Unusable vectors take no part, and repeated queries count once. Every
    block of queries meets every shard of its dimension; a task holds one block and one shard.
    """
    asked = usable(queries).select("vec_id", "embedding").distinct().withColumn("dims", F.size("embedding"))
    asked = stage(asked, "queries")
    blocks = max(1, -(-asked.count() // block))
    where = index.select(F.col("dims").alias("to_dims"), F.col("shard").alias("to_shard"))
    spread = (asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).join(where, F.col("dims") == F.col("to_dims"))
              .select("to_dims", "to_shard", "block", F.col("vec_id").alias("query_id"), "embedding"))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key: tuple, part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(part) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        row = part.iloc[0]
        vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dims"])
        sizes, members = np.array(row["sizes"]), np.frombuffer(row["members"], np.int64)
        first = np.cumsum(sizes) - sizes
        layers = [np.frombuffer(x, np.int32).reshape(-1, w).astype(np.int64) for x, w in zip(row["layers"], row["widths"])]
        ask = np.stack(wanted["embedding"].tolist()).astype(np.float32)
        ids = wanted["query_id"].to_numpy(np.int64)
        units, found = unit_rows(vectors), []
        for at in range(0, len(ask), _BATCH):
            nodes, near = search_graph(units, layers, unit_rows(ask[at:at + _BATCH]), max(beam, 2 * k + 4))
            for query, vector, hits in zip(ids[at:at + _BATCH], ask[at:at + _BATCH].astype(np.float64), nodes):
                hits = hits[hits >= 0]
                close = vectors[hits].astype(np.float64)
                score = (close * vector).sum(axis=1) / (np.sqrt((close ** 2).sum(axis=1)) * np.sqrt((vector ** 2).sum()))
                pairs = [(-s, int(m)) for s, h in zip(score, hits) for m in members[first[h]:first[h] + sizes[h]] if m != query]
                found += [(int(query), m, -s) for s, m in sorted(pairs)[:k]]
        return pd.DataFrame(found, columns=names)

    hits = (copies.groupBy("dims", "shard", "block").cogroup(spread.groupBy("to_dims", "to_shard", "block"))
            .applyInPandas(search, "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_vector_search(spark, folder: str) -> DataFrame:
    """Nearest neighbours of every fiftieth vector among all vectors."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors.where(F.col("vec_id") % QUERY_EVERY == 0), build_index(vectors))


QUERIES = {"op6_vector_search": op6_vector_search}
