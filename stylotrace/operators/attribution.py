"""Exact attribution of tree ensembles: path-dependent Shapley values of every row.

A tree is a sum over its leaves. On the way to a leaf each feature has one interval, and the share of the training
weight that the splits on this feature let through. If a feature is unknown, a row passes with that share; if it is
known, it passes or not. A leaf is therefore a product over few features, and the Shapley value of a product is the
integral of a polynomial over [0, 1], which Gauss-Legendre quadrature with half as many points as features gives exactly.

Rows that lie between the same cuts of a part of a tree have the same attributions from its leaves. So a tree is taken apart
into small trees, for each of which a table holds the sums over its leaves at every combination of places; a row looks
them up once for all these leaves. Blocks of rows meet parts of the forest in tasks of bounded size, whose sums are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylotrace.operators.forest import ForestModel
from stylotrace.session import materialise, shared_dir

CELLS_PER_PIECE = 4 << 20  # nodes of the trees that one task holds, about
CELLS_AT_ONCE = 1 << 20  # (row, leaf, feature) cells worked on at a time
CELLS_IN_TABLE = 1 << 14  # combinations of places in a table, and never more than there are rows
ROWS_AT_ONCE = 1 << 13  # rows that look a table up at a time
LEAVES_AT_ONCE = 1 << 12  # leaves worked on one by one that are held
ROWS_IN_BLOCK = 1 << 16  # rows in one task
CELLS_IN_BLOCK = 1 << 20  # and (row, feature) cells
PARTS = 32  # of the trees, at least
EDGE = 1 << 30  # above all cuts
OUTSIDE = -2  # a place below all cuts: on no path that asks for the feature
NODE_KINDS = {"id": np.int64, "left": np.int64, "right": np.int64, "feature": np.int32, "threshold": float, "weight": float, "p": float}


def node_table(classifier) -> DataFrame:
    """(tree, id, left, right, feature, threshold, weight, p) of every node of a fitted forest.

    ``weight`` is the training weight that reached the node, ``p`` the share of class 1 in it.
    """
    if isinstance(classifier, ForestModel):
        return classifier.node_table()
    spark = SparkSession.active()
    path = shared_dir(spark, "nodes")
    classifier.write().overwrite().save(path)
    n = F.col("nodeData")
    weight = F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"),
        n["id"].alias("id"),
        n["leftChild"].alias("left"),
        n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        weight.alias("weight"),
        (F.get(n["impurityStats"], F.lit(1)) / weight).alias("p"),
    )


class Leaves:
    """Leaves with equally many features on their paths, as flat arrays."""

    def __init__(self, rows: list[dict]) -> None:
        self.value = np.array([r["value"] for r in rows])
        self.feature = np.array([r["feature"] for r in rows], np.int64)
        self.low, self.high, self.share = (np.array([r[c] for r in rows]) for c in ("low", "high", "share"))


def leaf_attribution(x: np.ndarray, leaves: Leaves) -> tuple[np.ndarray, np.ndarray]:
    """Attributions (rows x features) and values (rows) of some leaves, for a matrix of rows."""
    n, d = x.shape
    k = leaves.feature.shape[1]
    out, value = np.zeros((n, d)), np.zeros(n)
    if k == 0:  # a tree that never splits
        return out, value + leaves.value.sum()
    points, weights = np.polynomial.legendre.leggauss((k + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    step = max(1, CELLS_AT_ONCE // (n * k))
    for start in range(0, len(leaves.value), step):
        part = slice(start, start + step)
        feature, share, v = leaves.feature[part], leaves.share[part], leaves.value[part]
        cells = x[:, feature]
        passes = (cells > leaves.low[part]) & (cells <= leaves.high[part])
        change = passes - share
        total = np.zeros(change.shape)
        for t, w in zip(points, weights, strict=True):
            factors = share + change * t
            total += (w * factors.prod(axis=2))[:, :, None] / factors
        total *= change * v[:, None]
        value += passes.all(axis=2) @ v
        flat, order = total.reshape(n, -1), np.argsort(feature.ravel(), kind="stable")
        present, first = np.unique(feature.ravel()[order], return_index=True)
        out[:, present] += np.add.reduceat(flat[:, order], first, axis=1)
    return out, value


def _tables(t: dict[str, list], bound: int) -> Iterator[tuple[dict, dict | None, list[tuple[dict, float]]]]:
    """The leaves of a tree, in parts that are trees of their own: the path to the part, the cuts of each feature inside it, and
    its leaves as (path, value). A path has for each feature the cuts (low, high] and the share let through.

    Inside a part, rows differ by at most ``bound`` combinations of places between its cuts. A leaf whose own path has more is
    a part without cuts (None).
    """
    left, right, feature, cut, weight, p = (t[c] for c in ("left", "right", "feature", "cut", "weight", "p"))
    path: dict[int, dict] = {t["root"]: {}}
    inside: dict[int, dict] = {}  # of nodes whose leaves still are one part
    leaves: dict[int, list[int]] = {}
    stack = [(t["root"], False)]
    while stack:
        at, below = stack.pop()
        up = path[at]
        if left[at] < 0:
            if 1 << len(up) > bound:
                yield up, None, [(path.pop(at), p[at])]
            else:
                inside[at], leaves[at] = {}, [at]
            continue
        f, c, sides = feature[at], cut[at], (left[at], right[at])
        if not below:
            low, high, share = up.get(f, (-1, EDGE, 1.0))
            for side, interval in zip(sides, ((low, min(high, c)), (max(low, c), high)), strict=True):
                path[side] = up | {f: (*interval, share * weight[side] / weight[at])}
            stack += [(at, True), (sides[1], False), (sides[0], False)]
            continue
        if all(x in inside for x in sides):
            both = dict(inside[sides[0]])
            for g, cuts in (*inside[sides[1]].items(), (f, frozenset([c]))):
                both[g] = both.get(g, frozenset()) | cuts
            if math.prod(len(both.get(g, ())) + 1 + (g in up) for g in both.keys() | up.keys()) <= bound:
                inside[at], leaves[at] = both, leaves.pop(sides[0]) + leaves.pop(sides[1])
                continue
        for x in sides:
            if x in inside:
                yield path[x], inside.pop(x), [(path[i] if i == x else path.pop(i), p[i]) for i in leaves.pop(x)]
            path.pop(x, None)
    if t["root"] in inside:
        yield {}, inside[t["root"]], [(path[i], p[i]) for i in leaves[t["root"]]]


def _outer(vectors: list[np.ndarray], n: int) -> np.ndarray:
    """The outer products of the rows of some matrices, row by row."""
    out = np.ones((n, 1))
    for x in vectors:
        out = (out[:, :, None] * x[:, None, :]).reshape(n, -1)
    return out


def _table(up: dict, inside: dict, leaves: list[tuple[dict, float]], bins: list[int]) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Features, per feature the step in the table of each of its bins, and the table: a column for every combination of places
    between the cuts, a row for every feature's attribution and a last one for the value, summed over the leaves.

    A leaf is a product over its features at each point of the quadrature, so its part of the table is an outer product, and the
    sum over leaves and points a product of two matrices.
    """
    features = sorted(up.keys() | inside.keys())
    steps, places, width = [np.zeros(0)] * len(features), [np.zeros(0)] * len(features), 1
    for j in reversed(range(len(features))):
        f = features[j]
        cuts, bin_ = np.array(sorted(inside.get(f, ())), np.int64), np.arange(bins[f])
        low, high, _ = up.get(f, (-1, EDGE, 1.0))
        at = np.searchsorted(cuts, bin_, "left")
        last = [cuts[-1] + 1] if len(cuts) else [min(high, EDGE - 1)]
        places[j] = np.array([*cuts, *last])
        if f in up:  # a row that has left the path before is in a place of its own
            at = np.where((bin_ > low) & (bin_ <= high), at + 1, 0)
            places[j] = np.array([OUTSIDE, *np.clip(places[j], low + 1, high)])
        steps[j] = at * width
        width *= len(places[j])
    points, weights = np.polynomial.legendre.leggauss(max(1, (max(len(x) for x, _ in leaves) + 1) // 2))
    points, weights = (points + 1) / 2, weights / 2
    m, n = len(leaves), len(leaves) * len(points)
    anywhere = (OUTSIDE - 1, EDGE, 1.0)
    ways = np.array([[x.get(f, anywhere) for f in features] for x, _ in leaves]).reshape(m, -1, 3)
    value = np.array([v for _, v in leaves])[:, None]
    passes, factors, changes = [], [], []
    for j, place in enumerate(places):
        low, high, share = (ways[:, j, k, None] for k in range(3))
        passes.append(((place > low) & (place <= high)).astype(float))
        change = np.broadcast_to((passes[-1] - share)[:, None, :], (m, len(points), len(place)))
        factors.append((share[:, :, None] + change * points[:, None]).reshape(n, -1))
        changes.append(change.reshape(n, -1))
    half, cells = 0, 1  # the features before and behind the middle give the two matrices
    while half < len(features) and cells * cells < width:
        cells *= len(places[half])
        half += 1
    weighted = (value * weights).reshape(n, 1)
    a, b = _outer(factors[:half], n) * weighted, _outer(factors[half:], n)
    out = np.empty((len(features) + 1, a.shape[1], b.shape[1]))
    for j in range(len(features)):
        if j < half:
            changed = _outer([*factors[:j], changes[j], *factors[j + 1 : half]], n) * weighted
            np.matmul(changed.T, b, out=out[j])
        else:
            np.matmul(a.T, _outer([*factors[half:j], changes[j], *factors[j + 1 :]], n), out=out[j])
    np.matmul((_outer(passes[:half], m) * value).T, _outer(passes[half:], m), out=out[-1])
    return features, steps, out.reshape(len(out), -1)


def _by_leaf(x: np.ndarray, leaves: list[tuple[dict, float]], out: np.ndarray) -> None:
    """Add the attributions and values of some leaves for rows of bins to ``out`` (features and value by rows)."""
    by_size: dict[int, list[dict]] = {}
    for path, value in leaves:
        items = sorted(path.items())
        low, high, share = ([i[k] for _, i in items] for k in range(3))
        row = {"value": value, "feature": [f for f, _ in items], "low": low, "high": high, "share": share}
        by_size.setdefault(len(items), []).append(row)
    for _, some in sorted(by_size.items()):
        held = Leaves(some)
        for start in range(0, len(x), 256):
            found, value = leaf_attribution(x[start : start + 256], held)
            out[:-1, start : start + 256] += found.T
            out[-1, start : start + 256] += value


def _attribution(x: np.ndarray, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Attributions (features) and value (last) of every row of ``x``, summed over trees: features + 1 by rows."""
    n, d = x.shape
    out = np.zeros((d + 1, n))
    used = np.concatenate([t["feature"] for t in trees])
    limits = np.concatenate([t["threshold"] for t in trees])
    cuts = [np.unique(limits[used == f]) for f in range(d)]
    bins, odd = [len(c) + 1 for c in cuts], np.isnan(x).any(axis=1)
    cells = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]) if d else np.zeros((0, n), np.int64)
    plain = np.where(np.isnan(x), np.nan, cells.T)  # a missing value is on no path
    even = np.flatnonzero(~odd)
    found, odd_found = np.zeros((d + 1, len(even))), np.zeros((d + 1, n - len(even)))
    cells, rare, lone = np.ascontiguousarray(cells[:, even]), plain[odd], plain[even]
    for tree in trees:
        cut = np.full(len(tree["id"]), -1)
        for f in np.unique(tree["feature"][tree["feature"] >= 0]):
            here = tree["feature"] == f
            cut[here] = np.searchsorted(cuts[f], tree["threshold"][here])
        sides = {s: np.where(tree["left"] < 0, -1, np.searchsorted(tree["id"], tree[s])) for s in ("left", "right")}
        below = np.concatenate([x[x >= 0] for x in sides.values()])
        root = int(np.setdiff1d(np.arange(len(cut)), below)[0])
        listed = {c: z.tolist() for c, z in (tree | sides | {"cut": cut}).items()}
        held: list[tuple[dict, float]] = []  # leaves that are worked on alone
        every: list[tuple[dict, float]] = []
        for up, inside, leaves in _tables(listed | {"root": root}, min(CELLS_IN_TABLE, max(1, len(even)))):
            if inside is None:
                held += leaves
            elif len(even):
                features, steps, table = _table(up, inside, leaves, bins)
                for start in range(0, len(even), ROWS_AT_ONCE):
                    some = slice(start, start + ROWS_AT_ONCE)
                    code = np.zeros(len(even[some]), np.int64)
                    for f, step in zip(features, steps, strict=True):
                        code += step.take(cells[f, some])
                    for f, column in zip([*features, -1], table, strict=True):
                        found[f, some] += column.take(code)
            if len(rare):
                every += leaves
            if len(held) + len(every) >= LEAVES_AT_ONCE:
                _by_leaf(lone, held, found)
                _by_leaf(rare, every, odd_found)
                held, every = [], []
        _by_leaf(lone, held, found)
        _by_leaf(rare, every, odd_found)
    out[:, even], out[:, odd] = found, odd_found
    return out


def _tree_rows(nodes: DataFrame) -> DataFrame:
    """One row per tree: its nodes, ordered by id, as numbers behind one another, and its mean over the training weight."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        columns = {c: table.column(c).to_numpy().astype(kind) for c, kind in NODE_KINDS.items()}
        leaf = columns["left"] < 0
        mean = (columns["p"][leaf] * columns["weight"][leaf]).sum() / columns["weight"][leaf].sum()
        found = {"tree": [table.column("tree")[0].as_py()], "n": [len(table)], "mean": [mean]}
        return pa.table(found | {c: [x.tobytes()] for c, x in columns.items()}).cast(schema)

    schema = pa.schema([("tree", pa.int32()), ("n", pa.int64()), ("mean", pa.float64()), *[(c, pa.binary()) for c in NODE_KINDS]])
    listed = "tree int, n long, mean double, " + ", ".join(f"{c} binary" for c in NODE_KINDS)
    found = nodes.select("tree", *[F.coalesce(c, F.lit(0)).alias(c) if c in ("feature", "threshold") else F.col(c) for c in NODE_KINDS])
    return materialise(found.groupBy("tree").applyInArrow(pack, listed))


def tree_attribution(rows: DataFrame, classifier, features: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """(id, feature, contribution, base, p) of every row for a fitted forest classifier over ``features`` in that order.

    The contributions of a row add up to its probability ``p`` less ``base``, the mean of the forest over its training
    weight. Nulls count as 0, as in the detectors' inputs. A row that is there twice has its contributions twice.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    trees = _tree_rows(node_table(classifier))
    sizes = trees.agg(F.count(F.lit(1)).alias("trees"), F.sum("n").alias("n"), F.avg("mean").alias("base")).first()  # one row
    n_trees, base, d = sizes["trees"], sizes["base"], len(features)
    vector = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    cells = materialise(rows.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("id"), vector.alias("x")))
    kind = cells.schema["id"].dataType.simpleString()
    blocks = max(1, math.ceil(cells.count() / max(256, min(ROWS_IN_BLOCK, CELLS_IN_BLOCK // d))))
    parts = min(n_trees, max(PARTS, math.ceil(sizes["n"] / CELLS_PER_PIECE)))  # of the trees, for every block of rows
    block = F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int").alias("block")

    def pack(table: pa.Table) -> pa.Table:
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = table.column("id").combine_chunks()
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.table([table.column("block")[:1], listed, pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])

    dealt = cells.select(block, "id", "x").repartition(blocks, "block")
    packed = materialise(dealt.groupBy("block").applyInArrow(pack, f"block int, ids array<{kind}>, x binary"))
    every_part, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (parts, blocks))
    places = 2 * max(cores, blocks * parts)
    of_rows = packed.select("block", every_part.alias("part"), "x").repartition(places, "block", "part")
    number = F.row_number().over(Window.orderBy("tree")) - 1  # one row per tree
    of_trees = trees.join(trees.select("tree", (number % parts).alias("part")), "tree")
    of_trees = of_trees.select(every_block.alias("block"), "part", "tree", *NODE_KINDS).repartition(places, "block", "part")

    def attribute(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
        if not len(left):
            return schema.empty_table()
        x = np.frombuffer(left.column("x")[0].as_py()).reshape(-1, d)
        here = right.sort_by("tree").select(list(NODE_KINDS)).to_pylist()
        sums = _attribution(x, [{c: np.frombuffer(t[c], k) for c, k in NODE_KINDS.items()} for t in here])
        return pa.table([left.column("block"), left.column("part"), pa.array([sums.tobytes()], pa.binary())], schema=schema)

    grid = of_rows.groupBy("block", "part").cogroup(of_trees.groupBy("block", "part"))
    sums = grid.applyInArrow(attribute, "block int, part int, sums binary")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        total = 0.0
        for part in right.sort_by("part").column("sums"):
            total = total + np.frombuffer(part.as_buffer()).reshape(d + 1, -1)
        ids = left.column("ids").combine_chunks().flatten()
        total = total / n_trees
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * d, pa.int32()), pa.array(total[:-1].T.ravel()))
        return pa.table([ids, lists, pa.array(total[-1])], ["id", "c", "p"])

    of_ids, of_sums = (df.repartition(max(cores, 2 * blocks), "block") for df in (packed.select("block", "ids"), sums))
    whole = of_ids.groupBy("block").cogroup(of_sums.groupBy("block")).applyInArrow(add_up, f"id {kind}, c array<double>, p double")
    names = F.array(*map(F.lit, features))
    listed = F.inline(F.transform(F.arrays_zip(names.alias("feature"), F.col("c").alias("contribution")), lambda z: z))
    return whole.select(F.col("id").alias(id_col), "p", listed).select(id_col, "feature", "contribution", F.lit(base).alias("base"), "p")
