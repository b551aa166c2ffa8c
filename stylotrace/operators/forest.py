"""Random forests whose trees are grown and stored in parts on the executors.

Features are cut into at most BINS bins. A node with many rows is split by a job over the whole table: each task adds up
counts per class and bin, and only the split of the node returns. As soon as a node has few rows, these are sent to one
group, in which the rest of the tree below it is grown. Nodes go from there to storage, never through the driver. How often
a tree draws a row follows from a hash of the row's number, so every pass sees the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylotrace.session import materialise, shared_dir

BINS = 32  # as many as Spark ML's forests look at
ROWS_IN_GROUP = 1 << 17  # rows of a node from which on one group grows the rest
CELLS_IN_GROUP = 48 << 20  # and (row, feature) cells, one byte each
CELLS_AT_ONCE = 1 << 20  # counts per bin held at a time
NODES_PER_PIECE = 2 << 20  # nodes that are broadcast at a time, or go to one task: about 17 MB
NODES_TOGETHER = 8 << 20  # nodes of a forest that every worker may hold; the pieces of a larger one stay apart
BYTES_OF_ROWS = 32 << 20  # binned rows that meet a piece in one task, about
LEAF = 255  # in place of a cut; BINS are fewer
DENSE = 256  # rows with up to this many features are kept as one byte for each
UNIT = float(1 << 20)  # weights are multiples of 1 / UNIT, so sums do not depend on their order
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
NODE_SQL = (
    "tree int, id long, left long, right long, feature int, threshold double, weight double, p double, gain double"
)
ROWS_SQL = "tree int, id long, row binary, draws binary, y binary, w binary, n binary, feature binary, bin binary"
NODE_COLUMNS = [c.split()[0] for c in NODE_SQL.split(", ")]
KINDS = {"row": np.int64, "draws": np.uint8, "y": np.uint8, "w": np.float64, "n": np.int32, "feature": np.int32, "bin": np.uint8}


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the stored entries of ML vectors, dense or sparse."""
    values, indices = vectors.field("values"), vectors.field("indices")
    n = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    sparse = vectors.field("type").to_numpy(zero_copy_only=False)[row] == 0
    feature[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, feature, values.flatten().to_numpy(zero_copy_only=False)


def bin_edges(vectors: DataFrame, d: int) -> list[np.ndarray]:
    """Per feature, the values at which a split may cut: quantiles of the entries that are not 0, and 0."""
    values = F.col("v.values")
    places = F.when(F.col("v.type") == 1, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.col("v.indices"))
    cells = vectors.where(F.size(values) > 0).select(F.inline(F.arrays_zip(places.alias("f"), values.alias("x")))).where("x != 0")
    wanted = [k / BINS for k in range(1, BINS)]
    found = cells.groupBy("f").agg(F.percentile_approx("x", wanted, 10000).alias("q")).collect()  # one row per feature
    edges = [np.zeros(1)] * d
    for r in found:
        cuts = sorted({*r["q"], 0.0})
        edges[r["f"]] = np.array(cuts)
    return edges


def _binned(row: np.ndarray, feature: np.ndarray, value: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of the feature's edges below each value."""
    out = np.zeros(len(value), np.uint8)
    order = np.argsort(feature, kind="stable")
    starts = np.flatnonzero(np.diff(feature[order], prepend=-1))
    for part in np.split(order, starts[1:]):
        if len(part):
            out[part] = np.searchsorted(edges[feature[part[0]]], value[part])
    return out


class Rows:
    """Binned rows of a batch or of a group."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.__dict__.update(columns)

    @classmethod
    def read(cls, table) -> Rows:
        blobs = {c: b"".join(table.column(c).to_pylist()) for c in KINDS}
        return cls({c: np.frombuffer(blobs[c], kind) for c, kind in KINDS.items()})

    def matrix(self, d: int, empty: np.ndarray) -> np.ndarray:
        """Bins as rows by features; entries that are not kept lie in the bin of 0."""
        if not len(self.n):
            return self.bin.reshape(-1, d)
        out = np.broadcast_to(empty, (len(self.y), d)).copy()
        out[np.repeat(np.arange(len(self.y)), self.n), self.feature] = self.bin
        return out

    def blobs(self, keep: np.ndarray, draws: np.ndarray, d: int) -> list[bytes]:
        """The chosen rows in the order of KINDS, without their numbers: below a node all is counted, in any order."""
        rows = [self.row[:0], draws[keep], self.y[keep], self.w[keep]]
        if not len(self.n):
            return [x.tobytes() for x in (*rows, self.n, self.feature, self.bin.reshape(-1, d)[keep])]
        cells = np.repeat(keep, self.n)
        return [x.tobytes() for x in (*rows, self.n[keep], self.feature[cells], self.bin[cells])]


def draws_of(row: np.ndarray, tree: int, seed: int, trees: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1; a single tree takes every row once."""
    if trees == 1:
        return np.ones(len(row), np.uint8)
    h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xD1B54A32D192ED03 + seed * 0x2545F4914F6CDD1D + 1) % (1 << 64))
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.searchsorted(POISSON, (h ^ (h >> np.uint64(32))) / 2.0**64, side="right").astype(np.uint8)


def features_of(tree: int, ids: np.ndarray, d: int, take: int, seed: int) -> np.ndarray:
    """The features that may split each of some nodes, drawn without replacement."""
    rng = np.random.default_rng([seed, tree, int(ids[0]), len(ids)])
    return np.argpartition(rng.random((len(ids), d)), take - 1, axis=1)[:, :take] if take < d else np.tile(np.arange(d), (len(ids), 1))


def _impurity(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    return 2.0 * w0 * w1 / np.maximum(w0 + w1, 1e-300)


def best_splits(counts: np.ndarray, features: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, last bin of the left side and gain of each node; a gain of 0 where nothing is won.

    ``counts`` has weight of class 0, of class 1 and draws by node, candidate feature and bin.
    """
    left = np.cumsum(counts, axis=3)
    whole = left[..., -1:]
    left = left[..., :-1]
    right = whole - left
    gain = _impurity(whole[0], whole[1]) - _impurity(left[0], left[1]) - _impurity(right[0], right[1])
    gain[(left[2] < leaf) | (right[2] < leaf) | (gain <= 1e-9 * (whole[0] + whole[1]))] = 0.0
    flat = gain.reshape(len(features), -1)
    at = flat.argmax(axis=1)
    nodes = np.arange(len(features))
    return features[nodes, at // gain.shape[2]], at % gain.shape[2], flat[nodes, at]


def _counts(bins: np.ndarray, row: np.ndarray, node: np.ndarray, features: np.ndarray, *of_row: np.ndarray) -> np.ndarray:
    """``best_splits``' counts for some rows of ``bins`` that lie in ``node`` 0, 1, ... and have weights, labels and draws."""
    w, y, draws = of_row
    m, take = features.shape
    cells = bins[row[:, None], features[node]].astype(np.int64)
    cells += ((node[:, None] * take) + np.arange(take)) * (BINS + 1)
    flat, size = cells.ravel(), m * take * (BINS + 1)
    sums = [np.bincount(flat, np.repeat(x, take), size) for x in (w * (y == 0), w * (y == 1), draws.astype(float))]
    return np.stack(sums).reshape(3, m, take, BINS + 1)


def _kept(bins: np.ndarray, row: np.ndarray, node: np.ndarray, features: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the cells that ``_counts`` looks at, those outside the bin of 0: place in ``row``, number of node and feature, and bin."""
    cells = bins[row[:, None], features[node]]
    at, place = np.nonzero(cells != empty[features][node])
    return at, node[at] * features.shape[1] + place, cells[at, place]


def _best_of_kept(
    found: list[tuple[np.ndarray, ...]], features: np.ndarray, leaf: int, empty: np.ndarray, node: np.ndarray, *of_row: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_splits`` of sparse rows from their ``_kept`` cells; ``of_row`` are weight of class 0, of class 1 and draws.

    Only pairs of a node and a feature with such a cell can win a split. What is not in a cell is in the bin of 0: weights
    are whole numbers, so the rest of the node is exact.
    """
    m, take = features.shape
    feature, cut, gain = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m)
    at, pair, bin_ = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(at):
        return feature, cut, gain
    used = np.zeros(m * take, bool)
    used[pair] = True
    pairs = np.flatnonzero(used)
    owner, flat = pairs // take, (np.cumsum(used) - 1)[pair] * (BINS + 1) + bin_
    counts = np.stack([np.bincount(flat, x[at], len(pairs) * (BINS + 1)) for x in of_row]).reshape(3, len(pairs), 1, BINS + 1)
    whole = np.stack([np.bincount(node, x, m) for x in of_row])
    own = features.ravel()[pairs]
    counts[:, np.arange(len(pairs)), 0, empty[own]] += whole[:, owner] - counts.sum(axis=3)[:, :, 0]
    _, cuts, gains = best_splits(counts, own[:, None], leaf)
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    best = np.flatnonzero(gains == np.repeat(np.maximum.reduceat(gains, start), np.diff(np.append(start, len(pairs)))))
    best = best[np.diff(owner[best], prepend=-1) != 0]  # the first of equals
    feature[owner[best]], cut[owner[best]], gain[owner[best]] = own[best], cuts[best], gains[best]
    return feature, cut, gain


def _grow(rows: Rows, tree: int, top: int, d: int, plan: Plan) -> dict[str, list[np.ndarray]]:
    """All nodes of a tree from node ``top`` downwards, level by level."""
    bins = rows.matrix(d, plan.empty)
    row = np.arange(len(rows.y))  # rows that are not in a leaf yet, by node
    y, draws, w = rows.y, rows.draws, rows.w * rows.draws
    at = np.full(len(row), top, np.int64)  # their nodes
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("id", "feature", "cut", "w0", "w1", "gain")}
    while len(at):
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        new = np.diff(at, prepend=-1) != 0
        start, node = np.flatnonzero(new), np.cumsum(new) - 1
        ids = at[start]
        w0, w1 = (np.bincount(node, w[row] * (y[row] == c), len(ids)) for c in (0, 1))
        feature, cut, gain = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.zeros(len(ids))
        level = int(ids[0]).bit_length() - 1
        open_ = np.flatnonzero((w0 > 0) & (w1 > 0)) if level < plan.depth else np.zeros(0, np.int64)
        step = max(1, CELLS_AT_ONCE // (plan.take * (BINS + 1)))
        ends = np.append(start, len(at))
        for first in range(0, len(open_), step):
            some = open_[first : first + step]
            place = np.full(len(ids), -1)
            place[some] = np.arange(len(some))
            span = slice(ends[some[0]], ends[some[-1] + 1])
            inside = place[node[span]]
            held = np.flatnonzero(inside >= 0) + span.start
            features = features_of(tree, ids[some], d, plan.take, plan.seed)
            block = max(1, CELLS_AT_ONCE // plan.take)
            blocks = [held[k : k + block] for k in range(0, len(held), block)]
            if len(rows.n):
                kept = [_kept(bins, row[h], place[node[h]], features, plan.empty) for h in blocks]
                kept = [(at + k * block, pair, bin_) for k, (at, pair, bin_) in enumerate(kept)]
                r = row[held]
                of_row = (w[r] * (y[r] == 0), w[r] * (y[r] == 1), draws[r].astype(float))
                feature[some], cut[some], gain[some] = _best_of_kept(kept, features, plan.leaf, plan.empty, place[node[held]], *of_row)
                continue
            counts = 0.0
            for h in blocks:
                r = row[h]
                counts = counts + _counts(bins, r, place[node[h]], features, w[r], y[r], draws[r])
            feature[some], cut[some], gain[some] = best_splits(counts, features, plan.leaf)
        feature[gain <= 0] = -1
        for c, x in zip(out, (ids, feature, cut, w0, w1, gain), strict=True):
            out[c].append(x)
        go = feature[node] >= 0
        row, node, at = row[go], node[go], at[go]
        at = 2 * at + (bins[row, feature[node]] > cut[node])
    return out


@dataclass
class Plan:
    """What all parts of a forest have in common."""

    trees: int
    depth: int
    leaf: int
    take: int
    seed: int
    edges: list[np.ndarray]
    empty: np.ndarray  # the bin of 0, by feature

    def table(self) -> np.ndarray:
        """The edges, a row for each feature."""
        out = np.zeros((len(self.edges), BINS))
        for f, e in enumerate(self.edges):
            out[f, : len(e)] = e
        return out

    def node_rows(self, tree: int, found: dict[str, list[np.ndarray]]) -> pa.Table:
        ids, feature, cut, w0, w1, gain = (np.concatenate(x) for x in found.values())
        splits = feature >= 0
        threshold = np.where(splits, self.table()[feature, cut], 0.0)
        weight = w0 + w1
        columns = [
            np.full(len(ids), tree, np.int32), ids, np.where(splits, 2 * ids, -1), np.where(splits, 2 * ids + 1, -1),
            feature.astype(np.int32), threshold, weight / UNIT, w1 / np.maximum(weight, 1e-300), gain / UNIT,
        ]
        return pa.Table.from_arrays([pa.array(c) for c in columns], NODE_COLUMNS)


def _pack(nodes: pa.Table, cuts: list[np.ndarray]) -> dict[str, list]:
    """A whole tree as one row: a word for each node, parents first, and the probabilities that occur in its leaves.

    A word has, from its lowest bit, 8 bits for the number of the cut, 24 for the feature and 31 for the place of the left
    child, which the right one follows; a leaf has LEAF for the cut and the place of its probability.
    """
    ids, feature, threshold, p = (nodes.column(c).to_numpy() for c in ("id", "feature", "threshold", "p"))
    order = np.argsort(ids)
    ids, feature, threshold, p = ids[order], feature[order].astype(np.int64), threshold[order], p[order]
    leaf = feature < 0
    leaves, place = np.unique(p[leaf], return_inverse=True)
    words = np.full(len(ids), LEAF, np.int64)
    words[leaf] |= place << 32
    cut = _binned(np.flatnonzero(~leaf), feature[~leaf], threshold[~leaf], cuts)
    words[~leaf] = (np.searchsorted(ids, 2 * ids[~leaf]) << 32) | (feature[~leaf] << 8) | cut
    return {"tree": [nodes.column("tree")[0].as_py()], "words": [words.tobytes()], "leaves": [leaves.tobytes()]}


Tops = list[dict[int, tuple[int, int]]]  # per tree: node -> feature and last bin of the left side


def _at(bins: np.ndarray, top: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node below the split ``top`` of a tree that each row reaches."""
    at = np.ones(len(bins), np.int64)
    for node in sorted(top):  # parents have smaller numbers
        feature, cut = top[node]
        here = at == node
        at[here] = 2 * node + (bins[here, feature] > cut)
    return at


def _packed(rows: DataFrame, d: int, edges: list[np.ndarray], missing_is_low: bool = False) -> DataFrame:
    """Binned rows, many to a row of the table, stored once."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)  # BINS numbers per feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, value = _entries(batch.column("v"))
            if d <= DENSE:
                x = np.zeros((len(batch), d))
                x[row, feature] = value
                row, feature, value = (z.ravel() for z in (*np.broadcast_arrays(np.arange(len(batch))[:, None], np.arange(d)), x))
            bins = _binned(row, feature, value, shared.value)
            if missing_is_low:
                bins[np.isnan(value)] = 0  # is over no threshold
            n, kept = (np.zeros(0), np.zeros(0)) if d <= DENSE else (np.bincount(row, minlength=len(batch)), feature)
            w = np.rint(batch.column("w").to_numpy(zero_copy_only=False) * UNIT)
            found = [batch.column("row").to_numpy(), np.zeros(len(batch)), batch.column("y").to_numpy(), w, n, kept, bins]
            blobs = [pa.array([x.astype(kind).tobytes()]) for x, kind in zip(found, KINDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(blobs, list(KINDS))

    return materialise(rows.mapInArrow(run, ROWS_SQL.split("id long, ")[1]))


def _split_large(packed: DataFrame, rows: int, d: int, plan: Plan) -> tuple[Tops, dict[tuple[int, int], tuple[float, float]]]:
    """The splits of all nodes that have too many rows for one group, a level of all trees at a time.

    Beside them the large nodes that stay leaves, with the weights of both classes.
    """
    spark = packed.sparkSession
    bound = max(1, min(ROWS_IN_GROUP, CELLS_IN_GROUP // d))
    tops: Tops = [{} for _ in range(plan.trees)]
    closed: dict[tuple[int, int], tuple[float, float]] = {}
    share_plan = spark.sparkContext.broadcast(plan)
    if rows <= bound:
        return tops, closed
    names = ["tree", "id", "place", "bin", "w0", "w1", "draws"]
    for level in range(plan.depth + 1):
        shared = spark.sparkContext.broadcast((plan, tops))

        def sizes(batches: Iterator[pa.RecordBatch], shared=shared, level=level) -> Iterator[pa.RecordBatch]:
            plan, tops = shared.value
            for batch in batches:
                for blob in range(len(batch)):
                    rows = Rows.read(batch.slice(blob, 1))
                    bins = rows.matrix(d, plan.empty)
                    out = []
                    for tree in range(plan.trees):
                        held = draws_of(rows.row, tree, plan.seed, plan.trees) > 0
                        ids, n = np.unique(_at(bins, tops[tree])[held], return_counts=True)
                        new = (ids >= 1 << level) & (ids < 2 << level)
                        out.append((np.full(new.sum(), tree), ids[new], n[new]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["tree", "id", "n"])

        counted = packed.mapInArrow(sizes, "tree long, id long, n long").groupBy("tree", "id").agg(F.sum("n").alias("n"))
        large: dict[int, list[int]] = {}
        for r in counted.where(F.col("n") > bound).collect():  # few: at most all draws over ``bound``
            large.setdefault(r["tree"], []).append(r["id"])
        if not large:
            break
        wanted = {tree: np.sort(ids) for tree, ids in large.items()}
        share = spark.sparkContext.broadcast(wanted)

        def add_up(batches: Iterator[pa.RecordBatch], shared=shared, share=share) -> Iterator[pa.RecordBatch]:
            plan, tops = shared.value
            for batch in batches:
                for blob in range(len(batch)):
                    rows = Rows.read(batch.slice(blob, 1))
                    bins = rows.matrix(d, plan.empty)
                    for tree, ids in share.value.items():
                        draws = draws_of(rows.row, tree, plan.seed, plan.trees)
                        at = _at(bins, tops[tree])
                        held = np.flatnonzero((draws > 0) & np.isin(at, ids))
                        features = np.concatenate([features_of(tree, ids[k : k + 1], d, plan.take, plan.seed) for k in range(len(ids))])
                        node = np.searchsorted(ids, at[held])
                        counts = _counts(bins, held, node, features, rows.w[held] * draws[held], rows.y[held], draws[held])
                        some = np.flatnonzero(counts[2].ravel())
                        m, place, b = np.unravel_index(some, counts.shape[1:])
                        columns = [np.full(len(some), tree), ids[m], place, b, *counts.reshape(3, -1)[:, some]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        def choose(cells: pa.Table) -> pa.Table:
            plan = share_plan.value
            tree, node = cells.column("tree")[0].as_py(), cells.column("id")[0].as_py()
            counts = np.zeros((3, 1, plan.take, BINS + 1))
            where = (0, cells.column("place").to_numpy(), cells.column("bin").to_numpy())
            for k, c in enumerate(("w0", "w1", "draws")):
                counts[k][where] = cells.column(c).to_numpy()
            features = features_of(tree, np.array([node]), d, plan.take, plan.seed)
            feature, cut, gain = best_splits(counts, features, plan.leaf)
            w0, w1, _ = counts[:, 0, 0].sum(axis=1)
            return pa.table({"tree": [tree], "id": [node], "feature": feature, "cut": cut, "gain": gain, "w0": [w0], "w1": [w1]})

        cells = packed.mapInArrow(add_up, "tree long, id long, place long, bin long, w0 double, w1 double, draws double")
        cells = cells.groupBy(*names[:4]).agg(*[F.sum(c).alias(c) for c in names[4:]])
        split = cells.groupBy("tree", "id").applyInArrow(choose, "tree long, id long, feature long, cut long, gain double, w0 double, w1 double")
        for r in split.collect():  # one row per large node
            if r["gain"] > 0 and level < plan.depth:
                tops[r["tree"]][r["id"]] = (r["feature"], r["cut"])
            else:
                closed[r["tree"], r["id"]] = (r["w0"], r["w1"])
    return tops, closed


def _top_nodes(parts: DataFrame, plan: Plan, tops: Tops) -> DataFrame:
    """Node rows of the splits that were made over the whole table, from the weights of the nodes grown below them."""
    splits = [(t, n, f, float(plan.edges[f][c])) for t, top in enumerate(tops) for n, (f, c) in top.items()]
    spark = parts.sparkSession
    listed = spark.createDataFrame(splits, "tree int, id long, feature int, threshold double")
    roots = parts.where("is_root").select("tree", F.col("id").alias("below"), "weight", (F.col("weight") * F.col("p")).alias("w1"))
    # A node is above another if the other's number begins with its own, bit by bit.
    steps = roots.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(31))))
    above = steps.select("tree", F.expr("shiftright(below, k)").alias("id"), F.expr("shiftright(below, k - 1) % 2").alias("side"), "weight", "w1")
    sums = above.where("id > 0").groupBy("tree", "id").agg(
        F.sum("weight").alias("weight"), F.sum("w1").alias("w1"),
        *[F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0.0)).alias(f"{c}_{s}") for s in (0, 1) for c in ("weight", "w1")],
    )
    gini = lambda w, one: 2.0 * one * (w - one) / w
    gain = gini(F.col("weight"), F.col("w1")) - gini(F.col("weight_0"), F.col("w1_0")) - gini(F.col("weight_1"), F.col("w1_1"))
    both = F.broadcast(listed).join(sums, ["tree", "id"])
    return both.select(
        "tree", "id", (F.col("id") * 2).alias("left"), (F.col("id") * 2 + 1).alias("right"), "feature", "threshold",
        "weight", (F.col("w1") / F.col("weight")).alias("p"), gain.alias("gain"),
    )


def fit_forest(train: DataFrame, preset: dict, max_depth: int, seed: int, features: str = "features", label: str = "y") -> ForestModel:
    """A forest over the vectors of ``features`` with the preset's trees, depth and smallest leaf; ``weight`` if balanced."""
    spark = train.sparkSession
    weight = F.col("weight") if preset["balanced"] else F.lit(1.0)
    good = F.when(F.col(label).isin(0, 1), F.col(label)).otherwise(F.raise_error(F.lit("labels have to be 0 or 1")))
    rows = materialise(train.select(
        F.unwrap_udt(features).alias("v"), good.cast("int").alias("y"), weight.cast("double").alias("w"))
    ).withColumn("row", F.monotonically_increasing_id())
    widest = rows.agg(F.max(F.coalesce("v.size", F.size("v.values"))).alias("d")).first()["d"]  # one row
    if not widest:
        raise ValueError("training rows with features are needed")
    d = int(widest)
    edges = bin_edges(rows, d)
    empty = np.array([np.searchsorted(e, 0.0) for e in edges], np.uint8)
    depth = min(preset["depth"] or max_depth, max_depth)
    take = max(1, int(np.ceil(np.sqrt(d)))) if preset["trees"] > 1 else d
    plan = Plan(preset["trees"], depth, preset["leaf"], take, seed, edges, empty)
    packed = _packed(rows, d, edges)
    tops, closed = _split_large(packed, rows.count(), d, plan)
    shared = spark.sparkContext.broadcast((plan, tops, closed))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, tops, closed = shared.value
        names = ["tree", "id", *KINDS]
        for batch in batches:
            for blob in range(len(batch)):
                rows = Rows.read(batch.slice(blob, 1))
                bins = rows.matrix(d, plan.empty) if any(tops) else None
                for tree in range(plan.trees):
                    draws = draws_of(rows.row, tree, plan.seed, plan.trees)
                    at = _at(bins, tops[tree]) if tops[tree] else np.ones(len(draws), np.int64)
                    out = [(tree, int(i), *rows.blobs((draws > 0) & (at == i), draws, d)) for i in np.unique(at[draws > 0]) if (tree, i) not in closed]
                    if out:
                        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * len(KINDS)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def grow(table: pa.Table) -> pa.Table:
        plan = shared.value[0]
        tree, top = table.column("tree")[0].as_py(), table.column("id")[0].as_py()
        found = plan.node_rows(tree, _grow(Rows.read(table), tree, top, d, plan))
        packed = _pack(found, plan.edges) if top == 1 else {}  # the whole tree
        for c in ("words", "leaves"):
            found = found.append_column(c, pa.array([*packed.get(c, [None]), *[None] * (len(found) - 1)], pa.binary()))  # the root is first
        return found.append_column("is_root", pc.equal(found.column("id"), top))

    places = 3 * spark.sparkContext.defaultParallelism
    dealt = packed.mapInArrow(deal, ROWS_SQL).repartition(max(places, plan.trees // 4), "tree", "id")
    parts = materialise(dealt.groupBy("tree", "id").applyInArrow(grow, NODE_SQL + ", words binary, leaves binary, is_root boolean"))
    if not closed and not any(tops):
        packs = parts.where("is_root").select("tree", "words", "leaves")
        return ForestModel(parts.select(*NODE_COLUMNS), d, plan.trees, edges, packs)
    parts = parts.drop("words", "leaves")
    if closed:
        leaves = [(t, i, -1, -1, -1, 0.0, (a + b) / UNIT, b / (a + b), 0.0, True) for (t, i), (a, b) in closed.items()]
        parts = parts.unionByName(spark.createDataFrame(leaves, NODE_SQL + ", is_root boolean"))
    nodes = parts.drop("is_root")
    if any(tops):
        nodes = materialise(nodes.unionByName(_top_nodes(parts, plan, tops)))
    return ForestModel(nodes, d, plan.trees, edges)


class _Trees:
    """Some whole trees of ``_pack``, one behind the other."""

    def __init__(self, packs: list) -> None:
        words, leaves = ([np.frombuffer(x[c], k) for x in packs] for c, k in (("words", np.int64), ("leaves", np.float64)))
        nodes, values = (np.cumsum([0, *map(len, x)]) for x in (words, leaves))
        moved = [w + (np.where((w & 255) == LEAF, v, n) << 32) for w, n, v in zip(words, nodes, values, strict=False)]
        self.words, self.leaves, self.roots = np.concatenate(moved), np.concatenate(leaves), nodes[:-1]

    def sums(self, bins: np.ndarray) -> np.ndarray:
        """Per row, the sum of the probabilities of its leaves."""
        n, d = bins.shape
        flat, cell = bins.ravel(), np.repeat(np.arange(n) * d, len(self.roots))
        at = np.tile(self.words[self.roots], n)  # the words that each row has come to
        live = np.flatnonzero((at & 255) != LEAF)
        while len(live):
            word = at[live]
            right = flat[cell[live] + ((word >> 8) & 0xFFFFFF)] > (word & 255)
            word = self.words[(word >> 32) + right]
            at[live] = word
            live = live[(word & 255) != LEAF]
        return self.leaves[at >> 32].reshape(n, -1).sum(axis=1)


@dataclass
class ForestModel:
    """A fitted forest: a table of nodes and what is needed to read it."""

    nodes: DataFrame
    n_features: int
    trees: int
    _cuts: list[np.ndarray] | None = None  # per feature, what contains its thresholds
    _packs: DataFrame | None = None  # trees that were grown in one group are packed there
    _shared: list | None = None
    _cut_up: tuple | None = None  # packed trees, the pieces' first and last trees, and the number of nodes

    def _packed_trees(self) -> DataFrame:
        if self._cuts is None:
            found = self.nodes.where("feature >= 0").groupBy("feature").agg(F.array_sort(F.collect_set("threshold")).alias("x"))
            self._cuts = [np.zeros(0)] * self.n_features
            for r in found.collect():  # one row per feature, at most BINS numbers
                self._cuts[r["feature"]] = np.array(r["x"])
        if self._packs is not None:
            return self._packs
        cuts = self.nodes.sparkSession.sparkContext.broadcast(self._cuts)

        def pack(nodes: pa.Table) -> pa.Table:
            return pa.table(_pack(nodes, cuts.value)).cast(pa.schema([("tree", pa.int32()), ("words", pa.binary()), ("leaves", pa.binary())]))

        columns = self.nodes.select("tree", "id", "feature", "threshold", "p")
        return columns.groupBy("tree").applyInArrow(pack, "tree int, words binary, leaves binary")

    def _spans(self) -> list[tuple[int, int]]:
        """First and last tree of each piece: at most NODES_PER_PIECE nodes or one tree. The trees are packed on the executors."""
        if self._cut_up is None:
            packs = materialise(self._packed_trees())
            spans: list[list[int]] = []
            held = size = 0
            for r in packs.select("tree", (F.length("words") / 8).cast("long").alias("n")).orderBy("tree").collect():  # one row per tree
                if not spans or held + r["n"] > NODES_PER_PIECE:
                    spans.append([r["tree"], 0])
                    held = 0
                spans[-1][1] = r["tree"]
                held += r["n"]
                size += r["n"]
            self._cut_up = packs, [(a, b) for a, b in spans], size
        return self._cut_up[1]

    def apart(self) -> bool:
        """Whether the forest is too large to be held by every worker."""
        self._spans()
        return self._cut_up[2] > NODES_TOGETHER

    def prepare(self) -> None:
        """Make what scoring needs."""
        if not self.apart():
            self.pieces()

    def pieces(self) -> list:
        """The cuts, then the trees, in broadcasts of at most NODES_PER_PIECE nodes or of one tree.

        8 bytes a node pass the driver, a piece at a time.
        """
        if self._shared is None:
            spans, context = self._spans(), self.nodes.sparkSession.sparkContext
            found = (self._cut_up[0].where(F.col("tree").between(a, b)).orderBy("tree").collect() for a, b in spans)
            self._shared = [context.broadcast(self._cuts), *[context.broadcast(_Trees(x)) for x in found]]
        return self._shared

    def probability(self, vector: Column) -> Column:
        """The forest's probability of class 1 for a column of vectors."""
        d, trees = self.n_features, self.trees
        cuts, *pieces = self.pieces()

        @F.arrow_udf("double")
        def run(v: pa.Array) -> pa.Array:
            row, feature, value = _entries(v)
            bin_ = _binned(row, feature, value, cuts.value)
            bin_[np.isnan(value)] = 0  # is over no threshold
            empty = np.array([np.searchsorted(c, 0.0) for c in cuts.value], np.uint8)
            out = np.zeros(len(v))
            step = max(1, min(256, CELLS_AT_ONCE // d))
            for first in range(0, len(v), step):
                some = slice(*np.searchsorted(row, [first, first + step]))
                bins = np.broadcast_to(empty, (min(step, len(v) - first), d)).copy()
                bins[row[some] - first, feature[some]] = bin_[some]
                for piece in pieces:
                    out[first : first + step] += piece.value.sums(bins) / trees
            return pa.array(out)

        return run(F.unwrap_udt(vector))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, a vector as Spark ML's classifiers give."""
        scored = self._scored_apart(df) if self.apart() else df.withColumn("_p", self.probability(F.col("features")))
        return scored.withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p")))).drop("_p")

    def _scored_apart(self, df: DataFrame) -> DataFrame:
        """Add ``_p``: rows go to the pieces of the forest, each task holds one of them, and the sums come back to the rows.

        The sums are those of ``probability``, in the same order.
        """
        d, trees, spans, packs = self.n_features, self.trees, self._spans(), self._cut_up[0]
        rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
        vectors = rows.select(F.unwrap_udt("features").alias("v"), F.lit(0).alias("y"), F.lit(1.0).alias("w"), F.col("_row").alias("row"))
        packed = _packed(vectors, d, self._cuts, missing_is_low=True).select(F.monotonically_increasing_id().alias("blob"), "row", "n", "feature", "bin")
        size = packed.agg(F.sum(F.length("bin") + F.length("feature") + F.length("n"))).first()[0] or 0  # one row
        cores = df.sparkSession.sparkContext.defaultParallelism
        shares = max(1, -(-size // BYTES_OF_ROWS), -(-2 * cores // len(spans)))  # of the rows, for every piece
        places = 2 * max(cores, shares * len(spans))
        every_piece, every_share = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (len(spans), shares))
        share = F.pmod(F.xxhash64("blob"), F.lit(shares)).cast("int").alias("share")
        piece = F.lit(0)
        for k, (first, _) in enumerate(spans[1:], 1):
            piece = F.when(F.col("tree") >= first, k).otherwise(piece)
        of_rows = packed.select("blob", "n", "feature", "bin", share, every_piece.alias("piece")).repartition(places, "piece", "share")
        of_trees = packs.select("tree", "words", "leaves", piece.alias("piece"), every_share.alias("share")).repartition(places, "piece", "share")
        empty = np.array([np.searchsorted(c, 0.0) for c in self._cuts], np.uint8)
        schema = pa.schema([("blob", pa.int64()), ("piece", pa.int32()), ("sums", pa.binary())])

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left):
                return schema.empty_table()
            held, out = _Trees(right.sort_by("tree").to_pylist()), []
            for blob in range(len(left)):
                n, feature, bin_ = (np.frombuffer(left.column(c)[blob].as_py(), KINDS[c]) for c in ("n", "feature", "bin"))
                ends = np.append(0, np.cumsum(n)) if d > DENSE else np.arange(len(bin_) // d + 1) * d
                sums, step = np.zeros(len(ends) - 1), max(1, min(256, CELLS_AT_ONCE // d))
                for first in range(0, len(sums), step):
                    last = min(first + step, len(sums))
                    span = slice(ends[first], ends[last])
                    if d > DENSE:
                        bins = np.broadcast_to(empty, (last - first, d)).copy()
                        bins[np.repeat(np.arange(last - first), n[first:last]), feature[span]] = bin_[span]
                    else:
                        bins = bin_[span].reshape(-1, d)
                    sums[first:last] = held.sums(bins) / trees
                out.append(sums.tobytes())
            return pa.table([left.column("blob"), left.column("piece"), pa.array(out, pa.binary())], schema=schema)

        def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
            total = 0.0
            for part in right.sort_by("piece").column("sums"):
                total = total + np.frombuffer(part.as_buffer())
            return pa.table([pa.array(np.frombuffer(left.column("row")[0].as_py(), np.int64)), pa.array(total)], ["_row", "_p"])

        sums = of_rows.groupBy("piece", "share").cogroup(of_trees.groupBy("piece", "share")).applyInArrow(score, "blob long, piece int, sums binary")
        of_blobs, of_sums = (x.repartition(2 * cores, "blob") for x in (packed.select("blob", "row"), sums))
        found = of_blobs.groupBy("blob").cogroup(of_sums.groupBy("blob")).applyInArrow(add_up, "_row long, _p double")
        return rows.join(found, "_row").drop("_row")

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802, as Spark ML names it
        """Gains by feature, as shares inside each tree, and their mean over the trees."""
        gains = self.nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
        whole = gains.groupBy("tree").agg(F.sum("g").alias("all"))
        shares = gains.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("s"))
        out = np.zeros(self.n_features)
        for r in shares.collect():  # one row per feature
            out[r["feature"]] = r["s"]
        return DenseVector(out / out.sum() if out.any() else out)

    def node_table(self) -> DataFrame:
        return self.nodes.select("tree", "id", "left", "right", "feature", "threshold", "weight", "p")

    def save(self, path: str) -> None:
        named = self.nodes.withColumns({"n_features": F.lit(self.n_features), "trees": F.lit(self.trees)})
        named.write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> ForestModel:
    stored = spark.read.parquet(path)
    first = stored.select("n_features", "trees").first()  # the same in every row
    return ForestModel(stored.drop("n_features", "trees"), first["n_features"], first["trees"])
