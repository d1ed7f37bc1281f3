"""Nearest neighbours by cosine from navigable small-world graphs, one per shard.

Vectors of one direction are one node, so many copies cannot tie a graph into knots. A
shard's graph has levels: a node is in each higher one with a fixed chance, and
on every level it knows its nearest nodes in different directions. Levels are
stored as flat arrays of neighbours. A search goes down from the top level and
widens on the lowest; the results of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from stowage.llm.tables import Scratch

#: Vectors of a shard and queries of a block, about.
SHARD_ROWS, BLOCK_QUERIES = 4096, 1024
#: Neighbours of a node on higher levels; on the lowest it has twice as many.
DEGREE = 16
#: Nearest nodes that neighbours are chosen from, and width of a search.
CONSIDERED, WIDTH = 64, 96


def _levels(n: int, degree: int) -> np.ndarray:
    """Levels of the nodes; a node reaches the next one with chance 1 / degree."""
    u = np.random.default_rng(n).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(degree)).astype(np.int64)


def _linked(x: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of each of the vectors, nearest first, in rows that -1 fills up."""
    n = len(x)
    most = min(CONSIDERED, n - 1)
    chosen = np.full((n, degree), -1, np.int32)
    if most < 1:
        return chosen
    for a in range(0, n, 256):
        rows = np.arange(a, min(a + 256, n))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -np.inf
        ids = np.argpartition(-near, most - 1, axis=1)[:, :most]
        score = np.take_along_axis(near, ids, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        ids, score = np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)
        mutual = np.einsum("ijd,ikd->ijk", x[ids], x[ids], optimize=True)
        # A candidate nearer to a chosen one than to the node lies in a direction already taken.
        taken = np.zeros(ids.shape, bool)
        for j in range(most):
            covered = (mutual[:, j, :] > score[:, j, None]) & taken
            taken[:, j] = ~covered.any(axis=1) & (taken.sum(axis=1) < degree // 2)
        # The nearest of the others fill half of the places at least.
        rank = np.where(taken, 0, 1) * most + np.arange(most)
        best = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        chosen[rows, : best.shape[1]] = np.take_along_axis(ids, best, axis=1)
    return _both_ways(chosen, degree)


def _both_ways(chosen: np.ndarray, degree: int) -> np.ndarray:
    """Adds the way back to each node that has room for it, so that every node can be reached."""
    n, m = chosen.shape
    wide = np.full((n, degree + degree // 2), -1, np.int32)
    wide[:, :m] = chosen
    used = (chosen >= 0).sum(axis=1)
    at, place = np.nonzero(chosen >= 0)
    to = chosen[at, place]
    order = np.lexsort((place, to))
    to, at = to[order], at[order]
    first = np.searchsorted(to, np.arange(n))
    for node in range(n):
        own = wide[node]
        for other in at[first[node] : first[node + 1] if node + 1 < n else len(at)]:
            if used[node] >= len(own):
                break
            if other not in own[: used[node]]:
                own[used[node]] = other
                used[node] += 1
    return wide


class Graph:
    """One shard's levels, from the lowest; a level has its nodes and their flat neighbours."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE) -> Graph:
        level = _levels(len(x), degree)
        levels = []
        for k in range(int(level.max()) + 1):
            nodes = np.flatnonzero(level >= k).astype(np.int32)
            rows = _linked(x[nodes], degree * (2 if k == 0 else 1))
            levels.append((nodes, np.where(rows >= 0, nodes[np.maximum(rows, 0)], -1)))
        return cls(levels)

    def search(self, x: np.ndarray, queries: np.ndarray, count: int, width: int = WIDTH) -> np.ndarray:
        """The nearest nodes found for each query, nearest first; -1 fills up."""
        m, n = len(queries), len(x)
        q = np.arange(m)
        here = np.full(m, self.levels[-1][0][0], np.int64)
        score = (x[here] * queries).sum(axis=1)
        for nodes, rows in reversed(self.levels[1:]):
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            moving = q
            while len(moving):
                around = rows[place[here[moving]]]
                near = np.einsum("ijd,id->ij", x[np.maximum(around, 0)], queries[moving])
                near[around < 0] = -np.inf
                best = near.argmax(axis=1)
                value = near[np.arange(len(moving)), best]
                better = value > score[moving]
                moving = moving[better]
                here[moving] = around[better, best[better]]
                score[moving] = value[better]
        rows = self.levels[0][1]
        width = min(max(width, count), n)
        ids = np.full((m, width), -1, np.int64)
        found = np.full((m, width), -np.inf, np.float32)
        ids[:, 0], found[:, 0] = here, score
        done = np.zeros((m, width), bool)
        seen = np.zeros((m, n), bool)
        seen[q, here] = True
        active = q
        while True:
            ahead = np.where(done[active] | (ids[active] < 0), -np.inf, found[active])
            pick = ahead.argmax(axis=1)
            open_ = ahead[np.arange(len(active)), pick] > -np.inf
            active, pick = active[open_], pick[open_]
            if not len(active):
                break
            done[active, pick] = True
            around = rows[ids[active, pick]]
            new = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
            seen[np.repeat(active, new.sum(axis=1)), around[new]] = True
            near = np.full(around.shape, -np.inf, np.float32)
            i, j = np.nonzero(new)
            near[i, j] = np.einsum("id,id->i", x[around[i, j]], queries[active[i]])
            both = np.concatenate([found[active], near], axis=1)
            names = np.concatenate([ids[active], np.where(new, around, -1)], axis=1)
            flags = np.concatenate([done[active], np.zeros(new.shape, bool)], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :width]
            found[active] = np.take_along_axis(both, order, axis=1)
            ids[active] = np.take_along_axis(names, order, axis=1)
            done[active] = np.take_along_axis(flags, order, axis=1)
        return ids[:, :count]

    def arrays(self) -> dict[str, np.ndarray]:
        return {
            "level_sizes": np.array([len(n) for n, _ in self.levels], np.int32),
            "nodes": np.concatenate([n for n, _ in self.levels]).astype(np.int32),
            "widths": np.array([r.shape[1] for _, r in self.levels], np.int32),
            "neighbours": np.concatenate([r.reshape(-1) for _, r in self.levels]).astype(np.int32),
        }

    @classmethod
    def stored(cls, sizes, nodes, widths, neighbours) -> Graph:
        levels, a, b = [], 0, 0
        for size, width in zip(sizes, widths, strict=True):
            rows = neighbours[b : b + size * width].reshape(size, width)
            levels.append((nodes[a : a + size], rows))
            a, b = a + size, b + size * width
        return cls(levels)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in single precision; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaled so that no square overflows or vanishes."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``vector`` of rows whose vector has only finite components, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    good = (
        F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), v.alias("vector")
    )


def _distinct(vectors: DataFrame, kept: int) -> DataFrame:
    """Distinct directions as bytes, and the smallest ids of each; a task sends a direction once.

    A direction is the vector divided by its largest component, as ``cosine`` does first, so that
    all rows of one have the same score.
    """

    def once(batches):
        ids_of: dict[bytes, set[int]] = {}
        for batch in batches:
            lists = batch.column(1)
            flat, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            if not batch.num_rows:
                continue
            largest = np.maximum.reduceat(np.abs(flat), bounds[:-1])
            flat = flat / np.repeat(largest, np.diff(bounds)) + 0.0  # one zero
            for vec_id, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                key = flat[a:b].tobytes()
                own = ids_of.setdefault(key, set())
                own.add(vec_id)
                if len(own) > 4 * kept:
                    ids_of[key] = set(sorted(own)[:kept])
        rows = list(ids_of.items())
        for i in range(0, len(rows), 5000):
            part = rows[i : i + 5000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, _ in part], pa.binary()),
                 pa.array([sorted(x)[:kept] for _, x in part], pa.list_(pa.int64()))],
                names=["vector", "ids"],
            )

    return vectors.mapInArrow(once, "vector binary, ids array<bigint>").groupBy("vector").agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, kept).alias("ids")
    )


_INDEX = ("dim int, shard int, ids array<array<bigint>>, vectors binary, level_sizes array<int>, "
          "nodes array<int>, widths array<int>, neighbours array<int>")


def build_index(
    vectors: DataFrame,
    scratch: Scratch,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Writes one row per shard (and dimension): directions, their smallest ids, and the flat graph."""
    nodes = scratch.write(_distinct(usable(vectors, id_col, vector_col), k + 1), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.select(
        (F.octet_length("vector") / 8).cast("int").alias("dim"),
        F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "ids", "vector",
    )

    def one_shard(table: pa.Table) -> pa.Table:
        data = b"".join(table.column("vector").to_pylist())
        x = np.frombuffer(data, np.float64).reshape(table.num_rows, -1)
        arrays = Graph.build(_unit(x)).arrays()
        return pa.table({
            "dim": table.column("dim")[:1], "shard": table.column("shard")[:1],
            "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([data], pa.binary()),
            **{name: pa.array([a], pa.list_(pa.int32())) for name, a in arrays.items()},
        })

    return scratch.write(nodes.groupBy("dim", "shard").applyInArrow(one_shard, _INDEX), "index")


def search_index(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    width: int = WIDTH,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, its cosine in double precision.

    Every query is searched in every shard of its dimension, blocks of queries
    against one shard at a time; a query's own id is not among its neighbours.
    """
    rows = usable(queries, id_col, vector_col).select(
        F.col("vec_id").alias("query_id"), F.size("vector").alias("dim"), "vector"
    )
    blocks = max(1, -(-rows.count() // BLOCK_QUERIES))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    stored = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = left.column("ids")[0].as_py()
            x = np.frombuffer(left.column("vectors")[0].as_py(), np.float64).reshape(len(ids), -1)
            graph = Graph.stored(*(
                left.column(c)[0].values.to_numpy()
                for c in ("level_sizes", "nodes", "widths", "neighbours")
            ))
            names = right.column("query_id").to_pylist()
            q = right.column("vector").combine_chunks().flatten().to_numpy().reshape(len(names), -1)
            near = graph.search(_unit(x), _unit(q), min(k + 3, len(ids)), width)
            at, place = np.nonzero(near >= 0)
            node = near[at, place]
            score = cosine(q[at], x[node])
            others: list[set[int]] = [set() for _ in names]

            def add(i: int, j: int, s: float) -> None:
                for vec_id in ids[j]:
                    if vec_id != names[i]:
                        others[i].add(vec_id)
                        out["query_id"].append(names[i])
                        out["vec_id"].append(vec_id)
                        out["score"].append(s)

            for i, j, s in zip(at, node, score, strict=True):
                add(i, j, s)
            for i, found in enumerate(others):
                if len(found) < k and near.shape[1] < len(ids):  # few ids have all nodes found
                    found.clear()
                    score = cosine(np.broadcast_to(q[i], x.shape), x)
                    last = -np.inf
                    for j in np.argsort(-score, kind="stable"):
                        if len(found) >= k and score[j] < last:
                            break
                        last = score[j]
                        add(i, j, last)
        return pa.table({
            "query_id": pa.array(out["query_id"], pa.int64()),
            "vec_id": pa.array(out["vec_id"], pa.int64()),
            "score": pa.array(out["score"], pa.float64()),
        })

    keys = ["dim", "shard", "block"]
    found = stored.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
        find, "query_id bigint, vec_id bigint, score double"
    )
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries``; see ``search_index``.

    Defined cases: vectors that are NULL, zero or hold a NULL or non-finite
    component take no part; vectors of another dimension are no neighbours;
    equal vectors are found by their smallest ids; rows with one id count once,
    with their largest score; with fewer candidates than ``k`` all are found; empty
    tables give an empty one; other columns don't matter.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    index = build_index(vectors, scratch, k, id_col, vector_col)
    return search_index(index, queries, k, id_col, vector_col)
