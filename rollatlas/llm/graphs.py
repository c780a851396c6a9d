"""Approximate nearest neighbours by cosine over sharded small-world graphs (operator 2).

Different vectors are dealt over shards of bounded size. Each shard gets a hierarchical navigable
small-world graph, stored as flat neighbour arrays: for each level the nodes on it and a row of
neighbours for each. Queries, in blocks, descend through the levels of every shard with a beam;
the shards' finds are scored exactly in double precision on the original vectors and merged.

Nodes are inserted in whole batches: a batch is searched against the graph so far and against
itself, keeps neighbours that are nearer to it than to each other, and is linked back.

Equal vectors are one node that carries its smallest ``k + 1`` ids: no query can have another of
them among its ``k`` nearest. Vectors that are null, all zero, or hold a null or a non-finite
number take no part, nor do rows without an id. Vectors only meet others of their length. A row
that is there twice with one id is found once. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollatlas.llm.shared import stage

K = 5
SHARD_ROWS = 8192
#: Neighbours on upper levels; the lowest level has twice as many.
DEGREE = 16
#: Beam while building and while searching.
BUILD_BEAM = 64
SEARCH_BEAM = 96
BATCH = 512
#: Beam entries that are opened in one round.
OPEN = 4
#: Queries that meet a shard in one task.
QUERY_ROWS = 8192

INDEX = (
    "dim int, shard int, vectors binary, ids array<array<long>>, level_sizes array<int>, nodes binary, neighbours binary"
)


def nearer_first(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.shape[1] > keep:
        part = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
        scores, ids = np.take_along_axis(scores, part, 1), np.take_along_axis(ids, part, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def beam_search(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, nodes) of the best ``beam`` nodes met from the entries; -1 where there are fewer.

    ``links``: row of neighbours of each node, -1 for none. ``entry``: nodes for each query.
    """
    q = len(queries)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, len(unit)), bool)
    seen[rows, entry] = True
    seen[:, -1] = True
    score = np.einsum("qd,qed->qe", queries, unit[entry])
    score[entry < 0] = -np.inf
    width = max(beam, entry.shape[1])
    scores = np.full((q, width), -np.inf, np.float32)
    nodes = np.full((q, width), -1)
    opened = np.ones((q, width), bool)
    e = entry.shape[1]
    scores[:, :e], nodes[:, :e], opened[:, :e] = score, entry, entry < 0
    active = np.arange(q)
    while len(active):
        waiting = np.where(opened[active], -np.inf, scores[active])
        pick = np.argpartition(-waiting, OPEN - 1, axis=1)[:, :OPEN]
        live = np.isfinite(np.take_along_axis(waiting, pick, 1))
        going = live.any(axis=1)
        active, pick, live = active[going], pick[going], live[going]
        if not len(active):
            break
        at = active[:, None]
        opened[at, pick] = True
        near = np.where(live[:, :, None], links[nodes[at, pick]], -1).reshape(len(active), -1)
        # A node met twice in one round counts once.
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[at, near]] = -1
        seen[at, near] = True
        found = np.einsum("qd,qed->qe", queries[active], unit[near])
        found[near < 0] = -np.inf
        all_scores = np.concatenate([scores[active], found], axis=1)
        all_nodes = np.concatenate([nodes[active], near], axis=1)
        all_opened = np.concatenate([opened[active], near < 0], axis=1)
        best = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        scores[active] = np.take_along_axis(all_scores, best, 1)
        nodes[active] = np.take_along_axis(all_nodes, best, 1)
        opened[active] = np.take_along_axis(all_opened, best, 1)
    return nearer_first(scores, nodes, beam)


def diverse(unit: np.ndarray, scores: np.ndarray, nodes: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's nodes (nearest first), up to ``degree`` that are nearer to the row's own node
    than to one already kept; rows that keep fewer are filled up with the nearest others."""
    n, width = nodes.shape
    kept = np.full((n, degree), -1)
    count = np.zeros(n, np.int64)
    taken = np.zeros((n, width), bool)
    own = unit[nodes]
    closest = np.full((n, width), -np.inf, np.float32)
    for j in range(width):
        good = (nodes[:, j] >= 0) & (count < degree) & (scores[:, j] > closest[:, j])
        rows = np.flatnonzero(good)
        if not len(rows):
            continue
        kept[rows, count[rows]] = nodes[rows, j]
        count[rows] += 1
        taken[rows, j] = True
        closest[rows] = np.maximum(closest[rows], np.einsum("nd,nwd->nw", own[rows, j], own[rows]))
    for j in range(width):
        rows = np.flatnonzero((nodes[:, j] >= 0) & ~taken[:, j] & (count < degree))
        kept[rows, count[rows]] = nodes[rows, j]
        count[rows] += 1
    return kept


def _link_back(unit: np.ndarray, links: np.ndarray, new: np.ndarray, degree: int) -> None:
    """Add the reverse of the new nodes' links; a full row is chosen anew."""
    target, source = links[new].ravel(), np.repeat(new, links.shape[1])
    target, source = target[target >= 0], source[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(nodes), degree + int(count.max(initial=0))), -1)
    wide[:, :degree] = links[nodes]
    place = np.arange(len(target)) - np.repeat(first, count)
    wide[np.repeat(np.arange(len(nodes)), count), degree + place] = source
    wide = np.sort(wide, axis=1)
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    for lo in range(0, len(nodes), BATCH):
        rows = slice(lo, lo + BATCH)
        score = np.einsum("nd,nwd->nw", unit[nodes[rows]], unit[wide[rows]])
        score[wide[rows] < 0] = -np.inf
        links[nodes[rows]] = diverse(unit, *nearer_first(score, wide[rows], min(wide.shape[1], 3 * degree)), degree)


def build_graph(unit: np.ndarray, degree: int = DEGREE, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, links) of each level, the lowest first; links are rows of node numbers. The last
    row of ``unit`` is the zero row that stands for no node."""
    n = len(unit) - 1
    draw = np.random.default_rng(seed).random(n)
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(degree)).astype(np.int64)
    graph: list[tuple[np.ndarray, np.ndarray]] = []
    for height in range(int(level.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(level >= height)
        # Those of the level above come first; they are the ways in.
        nodes = nodes[np.argsort(-np.minimum(level[nodes], height + 1), kind="stable")]
        own = 2 * degree if height == 0 else degree
        links = np.full((n + 1, own), -1)
        done = 0
        while done < len(nodes):
            new = nodes[done : done + min(BATCH, max(64, done))]
            inside = unit[new] @ unit[new].T
            np.fill_diagonal(inside, -np.inf)
            scores, found = inside, np.broadcast_to(new, inside.shape).copy()
            scores, found = nearer_first(scores, found, min(len(new), BUILD_BEAM))
            found[~np.isfinite(scores)] = -1
            if done:
                entry = _entries(unit, graph, unit[new], nodes[:1])
                more = beam_search(unit, links, unit[new], entry, BUILD_BEAM)
                scores, found = np.concatenate([scores, more[0]], axis=1), np.concatenate([found, more[1]], axis=1)
                scores, found = nearer_first(scores, found, min(scores.shape[1], BUILD_BEAM))
            links[new] = diverse(unit, scores, found, own)
            _link_back(unit, links, new, own)
            done += len(new)
        graph.insert(0, (nodes, links))
    return graph


def _entries(unit: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Nodes at which each query enters the level below ``above`` (levels, lowest first)."""
    entry = np.broadcast_to(above[-1][0][:1] if above else top, (len(queries), 1))
    for _, links in reversed(above):
        entry = beam_search(unit, links, queries, entry, 2 * OPEN)[1][:, :OPEN]
        entry = np.where(entry < 0, entry[:, :1], entry)
        entry = np.sort(entry, axis=1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
    return entry


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit rows, and one zero row at the end for the number -1."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    wide /= np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return np.concatenate([wide, np.zeros((1, wide.shape[1]))]).astype(np.float32)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows over a power of two each, which changes no cosine and keeps squares in range."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, keepdims=True))[1]) if len(wide) else wide


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, dim) of the rows that take part."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vector"), F.size(v).alias("dim")
    )


def build_index(rows: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> DataFrame:
    """One row for each shard of the (id, vector, dim) rows, with its graph in flat arrays."""
    order = W.partitionBy("vector").orderBy("id")
    # Row limits by key are cut in each task before anything moves.
    first = rows.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    nodes = stage(first.groupBy("vector", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")), "graph-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype("<f8")
        ids = table.column("ids").to_pylist()
        by_id = sorted(range(len(ids)), key=lambda i: ids[i])
        vectors, ids = vectors[by_id], [ids[i] for i in by_id]
        graph = build_graph(_unit(vectors), degree)
        flat = [links[nodes].astype("<i4").tobytes() for nodes, links in graph]
        return pa.Table.from_pydict({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()), "ids": pa.array([ids], pa.list_(pa.list_(pa.int64()))),
            "level_sizes": pa.array([[len(nodes) for nodes, _ in graph]], pa.list_(pa.int32())),
            "nodes": pa.array([b"".join(nodes.astype("<i4").tobytes() for nodes, _ in graph)], pa.binary()),
            "neighbours": pa.array([b"".join(flat)], pa.binary()),
        })

    keyed = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    return stage(keyed.groupBy("dim", "shard").applyInArrow(build, INDEX), "graph-index")


def _read_graph(row: dict, degree: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
    nodes, links = np.frombuffer(row["nodes"], "<i4"), np.frombuffer(row["neighbours"], "<i4")
    graph, at, place = [], 0, 0
    for height, size in enumerate(row["level_sizes"]):
        own = 2 * degree if height == 0 else degree
        full = np.full((len(vectors) + 1, own), -1)
        full[nodes[at : at + size]] = links[place : place + size * own].reshape(size, own)
        graph.append((nodes[at : at + size].astype(np.int64), full))
        at, place = at + size, place + size * own
    return vectors, graph


def search(
    index: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, degree: int = DEGREE,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest for each of the (id, vector, dim) queries."""

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]).empty_table()
        if not shard.num_rows or not asked.num_rows:
            return empty
        row = shard.to_pylist()[0]
        vectors, graph = _read_graph(row, degree)
        unit = _unit(vectors)
        exact = _scaled(vectors)
        length = np.sqrt((exact * exact).sum(axis=1))
        ids = row["ids"]
        query_id = asked.column("id").to_numpy()
        asked_vectors = asked.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, row["dim"])
        out: list[tuple[int, int, float]] = []
        for lo in range(0, len(query_id), BATCH):
            q = _scaled(asked_vectors[lo : lo + BATCH])
            q_unit = _unit(asked_vectors[lo : lo + BATCH])[:-1]
            entry = _entries(unit, graph[1:], q_unit, graph[0][0][:1])
            _, found = beam_search(unit, graph[0][1], q_unit, entry, max(beam, k + 1))
            best = found[:, : 4 * (k + 1)]
            score = (q[:, None, :] * exact[best]).sum(axis=2) / (np.sqrt((q * q).sum(axis=1))[:, None] * length[best])
            score[best < 0] = -np.inf
            for own, nodes, values in zip(query_id[lo : lo + BATCH].tolist(), best.tolist(), score.tolist()):
                near = [(-s, i) for node, s in zip(nodes, values) if node >= 0 for i in ids[node] if i != own]
                out += [(own, i, -s) for s, i in sorted(near)[:k]]
        if not out:
            return empty
        a, b, c = zip(*out)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    queries = stage(queries.distinct(), "graph-queries")
    groups = max(1, -(-queries.count() // query_rows))
    shards = index.select("dim", F.col("shard").alias("q_shard"))
    # Every query goes to every shard, in groups of bounded size; each group meets its own copy.
    spread = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    asked = spread.join(shards, "dim").select("id", "vector", F.col("dim").alias("q_dim"), "q_shard", F.col("part").alias("q_part"))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = copies.groupBy("dim", "shard", "part").cogroup(asked.groupBy("q_dim", "q_shard", "q_part")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
