"""Exact top-k search by inner product, with candidates in buckets of like length.

Candidates are grouped by their length, the longest ones first. A query first
meets one block of the longest vectors, which gives it a score to beat. Buckets
whose longest vector can't reach that score are left out for it; since lengths
fall, what stays is a range of buckets from the first one on. Within a bucket
the score to beat becomes a threshold for the cosine, and by that threshold a
query takes one of two ways: with a high one, a vector's largest coordinates can
only lie in narrow ranges, which sorted coordinates give at once; with a low one
only the vectors' lengths prune. What is left is verified by whole products.

Equal vectors are one node that carries its smallest ids, as many as a result
can name, so copies cost nothing and lose nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stowage.llm.tables import Scratch

#: Candidates in a block and queries in a group: one meets the other in one task.
BLOCK_ROWS, GROUP_QUERIES = 8192, 8192
#: Buckets of like length at most; a larger table has more blocks in a bucket.
MAX_BUCKETS = 256
#: Coordinates of a query whose ranges are looked at.
FOCUS = 3
#: Coordinate pruning must leave this part of a bucket or less: a gathered product costs more.
WORTH = 0.1
#: Lengths and cosines are rounded, so bounds are widened by this.
_SLACK = 1e-9
_STEPS = np.arange(0.05, 1.0, 0.05)
_CHUNK = 256
_FOUND = "qnum bigint, query_id bigint, vec_id bigint, score bigint"


def quantized(vector: Column, scale: int = 64) -> Column:
    """Components as floor(scale * x); NULL for a vector that is NULL or holds NULL, NaN or infinity."""
    exact = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(exact, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(exact, lambda x: F.floor(x * scale)))


def _length(vector: str) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def _matrix(column: pa.ChunkedArray, rows: int, dim: int) -> np.ndarray:
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, dim)


def _product_type(longest: float):
    """A type in which products of vectors with lengths up to this product are exact.

    Every partial sum of a product is at most the product of the two lengths.
    """
    return np.float32 if longest < 2**23 else np.float64 if longest < 2**52 else np.int64


class _Block:
    """Candidates of one block, longest first."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray]):
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.length, self.vectors = length[order], vectors[order]
        self.counts = np.array([len(ids[i]) for i in order], np.int64)
        self.ids = np.concatenate([ids[i] for i in order])
        self.starts = np.cumsum(self.counts) - self.counts
        self.unit = self.vectors / np.where(self.length > 0, self.length, 1)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of one coordinate of the directions, and its values."""
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f])
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def ranges(self, unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Per query and focus coordinate: first and last place of vectors that can have the cosine.

        A vector at an angle of at most d has each coordinate within an angle of d, too.
        """
        own = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
        reach = np.arccos(np.clip(cosine - 10 * _SLACK, -1, 1))[:, None]
        low = np.cos(np.minimum(np.pi, own + reach)) - 10 * _SLACK
        high = np.cos(np.maximum(0, own - reach)) + 10 * _SLACK
        out = np.empty((*focus.shape, 2), np.int64)
        for f in np.unique(focus):
            at = focus == f
            _, values = self.by_coordinate(f)
            out[at, 0] = np.searchsorted(values, low[at], "left")
            out[at, 1] = np.searchsorted(values, high[at], "right")
        self.low, self.high = low, high
        return out

    def cutoff(self, unit: np.ndarray, focus: np.ndarray) -> float:
        """The smallest cosine from which on coordinates leave few enough vectors of this block."""
        some = np.linspace(0, len(unit) - 1, min(len(unit), 16)).astype(int)
        for cosine in _STEPS:
            found = self.ranges(unit[some], focus[some], np.full(len(some), cosine))
            if (found[..., 1] - found[..., 0]).min(axis=1).mean() <= WORTH * len(self.unit):
                return cosine
        return 1.0


def _search(block: _Block, queries: np.ndarray, beat: np.ndarray, k: int):
    """Places of queries and nodes, and products, among them the best k + 1 of each query and ties."""
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    longest = block.length[0]
    kind = _product_type(longest * length.max())
    candidates, own = block.vectors.astype(kind), queries.astype(kind)
    reached = beat <= length * longest * (1 + _SLACK)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(beat > 0, beat / (length * longest), -1.0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pruned = np.zeros(len(queries), bool)
    high = reached & (cosine > 0) & (cosine <= 1 + _SLACK)
    if block.unit.shape[1] and high.any():
        unit = queries / np.where(length > 0, length, 1)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        pruned = high & (cosine >= block.cutoff(unit[high], focus[high]))
        at = np.flatnonzero(pruned)
        if len(at):
            spans = block.ranges(unit[at], focus[at], cosine[at])
            low, top = block.low, block.high
            sizes = spans[..., 1] - spans[..., 0]
            for i, q in enumerate(at):
                best = sizes[i].argmin()
                order, _ = block.by_coordinate(focus[q, best])
                places = order[spans[i, best, 0] : spans[i, best, 1]]
                places = places[block.length[places] * length[q] * (1 + _SLACK) >= beat[q]]
                for j, f in enumerate(focus[q]):
                    if j != best:
                        value = block.unit[places, f]
                        places = places[(value >= low[i, j]) & (value <= top[i, j])]
                scores = candidates[places] @ own[q]
                good = scores >= beat[q]
                found.append((np.full(good.sum(), q), places[good], scores[good]))

    rest = np.flatnonzero(reached & ~pruned)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(beat > 0, beat / length * (1 - 2 * _SLACK), 0.0)
    rest = rest[np.argsort(-least[rest], kind="stable")]
    for i in range(0, len(rest), _CHUNK):
        at = rest[i : i + _CHUNK]
        n = int(np.searchsorted(-block.length, -least[at].min(), "right"))
        if not n:
            continue
        scores = own[at] @ candidates[:n].T
        floor = beat[at]
        if n > k + 1:
            floor = np.maximum(floor, np.partition(scores, n - k - 1, axis=1)[:, n - k - 1])
        q, places = np.nonzero(scores >= floor[:, None])
        found.append((at[q], places, scores[q, places]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([f[j] for f in found]).astype(np.int64) for j in range(3))


def _matcher(k: int):
    """The function that searches one block for one group of queries."""

    def match(key, nodes: pa.Table, queries: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        empty = {"qnum": [], "query_id": [], "vec_id": [], "score": []}
        columns = {name: np.zeros(0, np.int64) for name in empty}
        if nodes.num_rows and queries.num_rows:
            vectors = _matrix(nodes.column("v"), nodes.num_rows, dim)
            ids = [np.array(x, np.int64) for x in nodes.column("ids").to_pylist()]
            block = _Block(vectors, ids)
            qnum = queries.column("qnum").to_numpy()
            query_id = queries.column("query_id").to_numpy()
            beat = np.array([-np.inf if b is None else float(b) for b in queries.column("beat").to_pylist()])
            q, node, score = _search(block, _matrix(queries.column("v"), queries.num_rows, dim), beat, k)
            # Each node stands for its ids, apart from the query's own.
            n = block.counts[node]
            ends = np.cumsum(n)
            at = np.repeat(block.starts[node] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            q, score, vec = np.repeat(q, n), np.repeat(score, n), block.ids[at]
            other = vec != query_id[q]
            q, score, vec = q[other], score[other], vec[other]
            order = np.lexsort((vec, -score, q))
            q, score, vec = q[order], score[order], vec[order]
            first = np.searchsorted(q, q, "left")
            best = np.arange(len(q)) - first < k
            columns = {"qnum": qnum[q[best]], "query_id": query_id[q[best]],
                       "vec_id": vec[best], "score": score[best]}
        return pa.table({name: pa.array(x, pa.int64()) for name, x in columns.items()})

    return match


def _nodes(vectors: DataFrame, ids: int) -> DataFrame:
    """Distinct vectors ``v``, each with its ``ids`` smallest ids, dimension and length."""
    w = W.partitionBy("v").orderBy("id")
    first = vectors.distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= ids)
    nodes = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return nodes.select("v", "ids", F.size("v").alias("dim"), _length("v").alias("length"))


def _numbers(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


class _Layout:
    """Buckets of like length, the longest first, and their blocks: both few numbers per bucket."""

    def __init__(self, nodes: DataFrame, block_rows: int):
        total = nodes.count()
        buckets = max(1, min(MAX_BUCKETS, -(-total // block_rows)))
        cuts = [i / buckets for i in range(1, buckets)]
        found = nodes.agg(F.percentile_approx("length", cuts, 10_000)).first()[0] if cuts and total else []
        self.bounds = sorted(set(found or []), reverse=True)
        sizes = nodes.groupBy(self.bucket().alias("b")).agg(
            F.count("*").alias("n"), F.max("length").alias("longest")).collect()  # a row per bucket
        by = {r["b"]: r for r in sizes}
        count = len(self.bounds) + 1
        self.parts = [max(1, -(-by[b]["n"] // block_rows)) if b in by else 1 for b in range(count)]
        self.first = [sum(self.parts[:b]) for b in range(count)]
        self.blocks = sum(self.parts)
        longest = [by[b]["longest"] if b in by else 0.0 for b in range(count)]
        self.longest = [max(longest[b:]) for b in range(count)]

    def bucket(self) -> Column:
        if not self.bounds:
            return F.lit(0)
        return F.size(F.filter(_numbers(self.bounds), lambda bound: F.col("length") < bound))

    def block(self) -> Column:
        bucket = F.col("bucket")
        part = F.pmod(F.xxhash64("v"), F.get(_numbers(self.parts), bucket))
        return (F.get(_numbers(self.first), bucket) + part).cast("int")

    def reach(self) -> Column:
        """The last bucket that can beat a query's score."""
        enough = F.filter(_numbers(self.longest), lambda longest: F.col("beat").isNull()
                          | (longest * F.col("length") * (1 + _SLACK) >= F.col("beat")))
        return F.size(enough) - 1


def top_products(
    candidates: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    block_rows: int = BLOCK_ROWS,
    group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """Per query ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the inner product.

    Both tables have whole-number vectors. A query gets the ``k`` candidates
    with the highest products, ties to the smaller id, all if there are fewer;
    candidates with its own id are left out.

    Defined cases: rows with a NULL id or vector, or a NULL component, take no
    part; a pair of different dimensions has no product; rows that agree in id
    and vector count once; an id with several vectors stands for each of them,
    as a query (a result each) and as a candidate; empty tables give no rows;
    vectors without components have product 0; products must fit 64 bits;
    other columns don't matter.
    """
    spark = candidates.sparkSession
    scratch = Scratch(spark, "products")
    plain = lambda df: df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v")
    ).where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    nodes = scratch.write(_nodes(plain(candidates), k + 1), "nodes")
    layout = _Layout(nodes, block_rows)
    placed = nodes.withColumn("bucket", layout.bucket()).withColumn("block", layout.block())
    asked = scratch.write(
        plain(queries).distinct().select(
            F.monotonically_increasing_id().alias("qnum"), F.col("id").alias("query_id"), "v",
            F.size("v").alias("dim"), _length("v").alias("length")), "queries")
    match = _matcher(k)

    # A score to beat: the k-th best among the first block of the longest vectors.
    groups = max(1, -(-asked.count() // group_queries))
    opening = placed.where("block = 0").select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "v", "ids")
    seekers = asked.select("dim", F.pmod(F.xxhash64("qnum"), F.lit(groups)).cast("int").alias("grp"),
                           "qnum", "query_id", "v", F.lit(None).cast("bigint").alias("beat"))
    first = scratch.write(
        opening.groupBy("dim", "grp").cogroup(seekers.groupBy("dim", "grp")).applyInArrow(match, _FOUND),
        "first")
    if layout.blocks == 1:
        return _ranked(first, k)
    bars = first.groupBy("qnum").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        "qnum", F.when(F.col("n") >= k, F.col("least")).alias("beat"))
    bound = scratch.write(asked.join(bars, "qnum", "left").withColumn("reach", layout.reach()), "bound")

    # Queries of like reach form groups; the farthest come first, so a bucket needs a range of them.
    per_reach = {r["reach"]: r["count"] for r in bound.groupBy("reach").count().collect()}
    reaches, starts, parts, waiting = [], {}, {}, []
    grps = pending = 0

    def close():
        nonlocal grps, pending
        n = max(1, -(-pending // group_queries))
        for reach in waiting:
            starts[reach], parts[reach] = grps, n
        reaches.extend([max(waiting)] * n)
        grps, pending = grps + n, 0
        waiting.clear()

    for reach in sorted((r for r in per_reach if r >= 0), reverse=True):
        waiting.append(reach)
        pending += per_reach[reach]
        if pending >= group_queries:
            close()
    if waiting:
        close()
    if not grps:
        return _ranked(first, k)
    buckets = range(len(layout.parts))
    start_of, parts_of = ([d.get(b, 0) for b in buckets] for d in (starts, {b: parts.get(b, 1) for b in buckets}))
    needed = [sum(r >= b for r in reaches) for b in buckets]
    reach_of = [reaches[start_of[b]] for b in buckets]
    last = [layout.first[reach_of[b]] + layout.parts[reach_of[b]] - 1 for b in buckets]
    left = placed.where("block > 0").withColumn("needed", F.get(_numbers(needed), F.col("bucket"))).where(
        "needed > 0").select(
        "dim", "block", F.explode(F.sequence(F.lit(0), F.col("needed") - 1)).alias("grp"), "v", "ids")
    right = bound.where("reach >= 0").withColumn("last", F.get(_numbers(last), F.col("reach"))).where(
        "last > 0").select(
        "dim", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("block"),
        (F.get(_numbers(start_of), F.col("reach"))
         + F.pmod(F.xxhash64("qnum"), F.get(_numbers(parts_of), F.col("reach")))).cast("int").alias("grp"),
        "qnum", "query_id", "v", "beat")
    keys = ["dim", "block", "grp"]
    rest = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, _FOUND)
    return _ranked(first.unionByName(rest), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("qnum").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
