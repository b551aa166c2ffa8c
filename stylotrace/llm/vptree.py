"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard holds one vantage-point tree: a node
splits its points by their distance to a vantage point, leaves hold a few dozen. Inner products become distances
by one more coordinate that lifts all vectors to the largest norm; then the nearest point is the one with the
largest product. By the triangle inequality a subtree can be skipped when its shell of distances lies further
from the query than the best found so far. The factor relaxes this test: with 1 the search is exact, above 1 it
skips more.

The rows of a shard and the queries are sorted so that a task first reads the shard, builds its tree once, and then
streams the queries past it in blocks. Vectors of the base move once, or, with fewer shards than cores, once for each of
the parts that the queries are dealt to. The best of each shard are merged by a ranked window, cut to k in every
partition before the shuffle. Many equal vectors only make
a node whose shell has no width; they are told apart by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.llm.support import stored

SHARD_ROWS = 1 << 14
BLOCK_ROWS = 1 << 11
LEAF = 64
FACTOR = 1.15


@dataclass
class Tree:
    """Points in tree order. Node i covers rows start[i] to stop[i]; the first of them is its vantage point."""

    ids: np.ndarray
    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    inner: np.ndarray  # child nodes, -1 in leaves
    outer: np.ndarray
    shells: np.ndarray  # least and largest distance of the inner and of the outer child to the vantage point


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    rows = np.arange(len(ids))
    nodes: list[list] = []
    todo = [(0, len(rows), -1, 0)]
    while todo:
        start, stop, parent, side = todo.pop()
        here = len(nodes)
        nodes.append([start, stop, -1, -1, [0.0, 0.0, 0.0, 0.0]])
        if parent >= 0:
            nodes[parent][2 + side] = here
        if stop - start <= leaf:
            continue
        part = rows[start:stop]
        # The point furthest from the first one lies at the rim, which spreads the distances.
        far = np.argmax(((points[part] - points[part[0]]) ** 2).sum(axis=1))
        part[[0, far]] = part[[far, 0]]
        gap = np.sqrt(((points[part[1:]] - points[part[0]]) ** 2).sum(axis=1))
        sort = np.argsort(gap, kind="stable")
        part[1:], gap = part[1:][sort], gap[sort]
        half = len(gap) // 2
        nodes[here][4] = [gap[0], gap[half - 1], gap[half], gap[-1]]
        todo += [(start + 1, start + 1 + half, here, 0), (start + 1 + half, stop, here, 1)]
    start, stop, inner, outer = (np.array([n[k] for n in nodes], np.int64) for k in range(4))
    return Tree(ids[rows], points[rows], start, stop, inner, outer, np.array([n[4] for n in nodes]).reshape(-1, 4))


class _Best:
    """The k best candidates of each query: largest score, then smallest id."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = scores.max(axis=1, initial=-np.inf) >= self.score[who, -1]
        who, scores = who[keep], scores[keep]
        if not len(who):
            return
        score = np.concatenate([self.score[who], scores], axis=1)
        names = np.concatenate([self.id[who], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((names, -score), axis=1)[:, : self.score.shape[1]]
        self.score[who] = np.take_along_axis(score, order, axis=1)
        self.id[who] = np.take_along_axis(names, order, axis=1)


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order, so that equal vectors get equal scores."""
    return np.einsum("qd,nd->qn", queries, points)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, norm: float, k: int, factor: float) -> _Best:
    """The k best rows of a tree for each query, its own id left out. Queries walk the tree together."""
    best, lifts = _Best(len(queries), k), np.sqrt(np.maximum(norm**2 - (tree.points**2).sum(axis=1), 0))
    square = (queries**2).sum(axis=1) + norm**2

    def reach() -> np.ndarray:  # distance of the k-th best so far
        return np.sqrt(np.maximum(square - 2 * best.score[:, -1], 0))

    def offer(who: np.ndarray, rows: slice) -> np.ndarray:
        scores = products(queries[who], tree.points[rows])
        own = query_ids[who][:, None] == tree.ids[rows][None, :]
        best.offer(who, tree.ids[rows], np.where(own, -np.inf, scores))
        return scores

    def shell_gap(node: int, gap: np.ndarray) -> list[np.ndarray]:
        low_in, high_in, low_out, high_out = tree.shells[node]
        return [np.maximum(np.maximum(a - gap, gap - b), 0) for a, b in ((low_in, high_in), (low_out, high_out))]

    def distance(node: int, who: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square[who] - 2 * scores[:, 0], 0))

    # First every query goes straight down to one leaf, for a first reach.
    lifted = lambda rows: slice(tree.start[rows], tree.start[rows] + 1)
    homes: dict[int, list[np.ndarray]] = {}
    todo = [(0, np.arange(len(queries)))] if len(tree.ids) else []
    while todo:
        node, who = todo.pop()
        if tree.inner[node] < 0:
            homes[node] = [who]
            offer(who, slice(tree.start[node], tree.stop[node]))
            continue
        gap = distance(node, who, products(queries[who], tree.points[lifted(node)]))
        inside, outside = shell_gap(node, gap)
        for child, part in ((tree.inner[node], who[inside <= outside]), (tree.outer[node], who[inside > outside])):
            if len(part):
                todo.append((int(child), part))
    # Then one walk over the nodes; a subtree is entered by the queries that its shell may still serve.
    todo = [(0, np.arange(len(queries)))] if len(tree.ids) else []
    while todo:
        node, who = todo.pop()
        if tree.inner[node] < 0:
            who = np.setdiff1d(who, homes[node][0], assume_unique=True) if node in homes else who
            if len(who):
                offer(who, slice(tree.start[node], tree.stop[node]))
            continue
        gap = distance(node, who, offer(who, lifted(node)))
        limit = reach()[who] * (1 + 1e-9) + 1e-9
        inside, outside = shell_gap(node, gap)
        for child, bound in ((tree.outer[node], outside), (tree.inner[node], inside)):
            part = who[bound * factor <= limit]
            if len(part):
                todo.append((int(child), part))
    return best


# On Spark --------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components present and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def nearest(
    base: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of ``base`` with the largest inner product.

    Both have (vec_id, embedding) with embeddings of one length; usable ones of several lengths are an error. Products are in double precision on the original
    vectors; ties go to the smaller vec_id; a row is no candidate of the query with its own id. Rows without an
    id, and vectors that are null, zero or hold a null or non-finite component, take no part. Of rows that repeat
    an id the one with the smallest embedding counts. ``factor`` 1 is exact search.
    """
    def prepared(df: DataFrame) -> DataFrame:
        fit = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        one = fit.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        return stored(one.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), "vectors")

    points, asked = prepared(base), prepared(queries)
    squares = points.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), F.count(F.lit(1))).first()
    norm, shards = math.sqrt(squares[0] or 0.0) * (1 + 1e-12), max(1, math.ceil(squares[1] / shard_rows))
    lengths = points.select(F.size("vector").alias("n")).union(asked.select(F.size("vector"))).agg(F.min("n"), F.max("n")).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors of {lengths[0]} and of {lengths[1]} entries")
    # Every query meets every shard: the stated query set against all rows, in blocks.
    parts = max(1, math.ceil(2 * points.sparkSession.sparkContext.defaultParallelism / shards))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = points.select(deal(shards).alias("shard"), everywhere(parts).alias("part"), F.lit(0).alias("kind"), "id", "vector")
    rows = rows.unionByName(
        asked.select(everywhere(shards).alias("shard"), deal(parts).alias("part"), F.lit(1).alias("kind"), "id", "vector")
    )
    cells = rows.repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, tree = None, [], None
        for batch in batches:
            here = np.stack([batch.column(c).to_numpy() for c in ("shard", "part", "kind")], axis=1)
            edges = np.flatnonzero((here[1:] != here[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *edges], [*edges, len(here)], strict=True):
                if start == stop:
                    continue
                if cell != (here[start, 0], here[start, 1]):
                    cell, held, tree = (here[start, 0], here[start, 1]), [], None
                names = batch.column("id").slice(start, stop - start).to_numpy()
                vectors = batch.column("vector").slice(start, stop - start).flatten().to_numpy().reshape(len(names), -1)
                if here[start, 2] == 0:
                    held.append((names, vectors))
                    continue
                if held:
                    tree, held = build(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                for at in range(0, len(names) if tree else 0, block_rows):
                    mine = names[at : at + block_rows]
                    best = search(tree, mine, vectors[at : at + block_rows], norm, k, factor)
                    found = np.isfinite(best.score)
                    columns = [np.repeat(mine, k)[found.ravel()], best.id[found], best.score[found]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
