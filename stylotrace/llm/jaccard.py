"""N-gram Jaccard join with several global orders, and the components of its links.

If two sets reach the similarity, they share a token among the first few of each under any order of all tokens
(the prefix filter). Three orders are used and a pair has to pass all of them before its sets are compared:

* order A is by hash, but tokens that many documents hold come last. It deals out candidates: documents meet under
  the tokens of their prefixes, within ranges of compatible sizes.
* orders B and C are by other hashes. Together with the sizes and with token counts by part of the token space (an
  upper bound of the overlap) they thin the candidates out.

Equal sets are one node. Groups of near copies never emit all their pairs: first every node meets the most typical node
of its buckets, the one that most variants of a text are close to; what is linked becomes a component; then only pairs across components are left, and all of these
are tried. Links inside a component would change nothing. Results are exact, up to equal 64-bit hashes of
different shingles or sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.llm.support import few, free_name, one_of_repeats, stored

CHUNK = 1 << 21  # bytes of text that are hashed at once
LOW = 0.3  # share of the token space in which frequent tokens are looked for
FREQUENT = 64  # documents from which on a token counts as frequent, at least
FREQUENT_LIMIT = 1 << 20  # frequent tokens at most: they are broadcast; the rarer of them then keep their places
PARTS = 128

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, once for each worker."""
    if not _powers:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            row = np.full(CHUNK + 1, base, np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, a different one for each seed."""
    h = h + np.uint64((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the words in at most CHUNK bytes: a polynomial over their lower-cased bytes.

    Dividing running sums by the power at the word's start gives a word the same number wherever it stands.
    """
    inside = ~BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    up, down = powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[LOWER[data]] * up[: len(data)], dtype=np.uint64)])
    return starts, mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def _cut(data: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of a long text, cut at blanks; a word beyond CHUNK bytes stands for its number by pieces."""
    start = 0
    while start < len(data):
        stop = min(start + CHUNK, len(data))
        if stop < len(data):
            blanks = np.flatnonzero(BLANK[data[start:stop]])
            stop = start + int(blanks[-1]) + 1 if len(blanks) else stop
        yield data[start:stop]
        start = stop


def by_text(text: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    """The order of ``np.lexsort((key, text))``, in a third of its time; equal pairs may come in any order.

    ``texts`` is the number of texts. Up to 65,536 of them are sorted by radix.
    """
    order = np.argsort(key)
    number = text[order]
    return order[np.argsort(number.astype(np.uint16) if texts <= 1 << 16 else number, kind="stable")]


def shingles(words: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts with ``count`` words each: (text number, 64-bit shingle), sorted by text."""
    text = np.repeat(np.arange(len(count)), count)
    index = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    left = np.repeat(count, count) - index
    grams = np.zeros(len(words), np.uint64)
    for k in range(width):
        part = np.concatenate([words[k:], np.zeros(min(k, len(words)), np.uint64)])
        grams = mix(grams ^ np.where(left > k, part, np.uint64(0)), k + 1)
    keep = (left >= width) | ((index == 0) & (left < width))  # fewer words are one sequence
    text, grams = text[keep], grams[keep]
    order = by_text(text, grams, len(count))
    text, grams = text[order], grams[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    return text[new], grams[new]


class Sets:
    """Shingle sets of consecutive documents of a batch: documents ``start`` up to ``start + len(n)``."""

    def __init__(self, start: int, text: np.ndarray, grams: np.ndarray, n: np.ndarray) -> None:
        self.start, self.text, self.grams, self.n = start, text, grams, n
        self.first = np.cumsum(n) - n
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams, 9), dtype=np.uint64)])
        self.node = mix(sums[self.first + n] - sums[self.first] + n.astype(np.uint64), 10).view(np.int64)

    def prefix_length(self, threshold: int) -> np.ndarray:
        return self.n + (-threshold * self.n) // 100 + 1

    def prefix(self, key: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text numbers, tokens and places of the prefixes under the order of ``key``."""
        order = by_text(self.text, key, len(self.n))
        sorted_key = key[order]
        if ((sorted_key[1:] == sorted_key[:-1]) & (self.text[1:] == self.text[:-1])).any():
            order = np.lexsort((key, self.text))  # equal keys of different tokens keep the tokens' order
        place = np.arange(len(order)) - self.first[self.text]
        inside = place < self.prefix_length(threshold)[self.text]
        return self.text[inside], self.grams[order][inside], place[inside]


def sets_of(column: pa.Array, width: int) -> Iterator[Sets]:
    """The sets of a column of texts in groups of about CHUNK bytes; long texts are hashed piece by piece."""
    raw = pa.compute.cast(column, pa.large_binary()).fill_null(b"")
    start, held, size = 0, [], 0
    for i in range(len(raw) + 1):
        value = raw[i].as_buffer() if i < len(raw) else None
        length = value.size + 1 if value is not None else 0
        if held and (value is None or size + length > CHUNK):
            data = np.frombuffer(b" ".join([*held, b""]), np.uint8)
            starts, words = _word_hashes(data)
            ends = np.cumsum([len(h) + 1 for h in held])
            count = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(held))
            text, grams = shingles(words, count, width)
            yield Sets(start, text, grams, np.bincount(text, minlength=len(held)))
            start, held, size = i, [], 0
        if length > CHUNK:
            words = np.concatenate([_word_hashes(piece)[1] for piece in _cut(np.frombuffer(value, np.uint8))])
            text, grams = shingles(words, np.array([len(words)]), width)
            yield Sets(i, text, grams, np.array([len(grams)]))
            start = i + 1
        elif value is not None:
            held.append(value.to_pybytes())
            size += length


# Columns of the stored tables: one row per document; tokens of the low part of the token space; prefixes.


def _signature(sets: Sets, threshold: int) -> list[bytes]:
    """Per text: prefixes under orders B and C as 16-bit numbers, and token counts of the parts."""
    parts = np.zeros((len(sets.n), PARTS), np.uint16)
    where = (mix(sets.grams, 11) % np.uint64(PARTS)).astype(np.int64)
    counts = np.bincount(sets.text * PARTS + where, minlength=parts.size)
    parts.ravel()[:] = np.minimum(counts, 65535)
    orders = []
    for seed in (12, 13):
        text, token, _ = sets.prefix(mix(sets.grams, seed), threshold)
        marks = (mix(token, seed + 2) >> np.uint64(48)).astype(np.uint16)
        orders.append(np.split(marks, np.cumsum(np.bincount(text, minlength=len(sets.n)))[:-1]))
    return [parts[i].tobytes() + orders[0][i].tobytes() + orders[1][i].tobytes() for i in range(len(sets.n))]


def _documents(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in sets_of(batch.column("text"), width):
                ids = batch.column("doc_id").slice(sets.start, len(sets.n))
                columns = [ids, pa.array(sets.node), pa.array(sets.n.astype(np.int32)), pa.array(_signature(sets, threshold))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "signature"])

    rows = docs.mapInArrow(run, "doc_id long, node long, n int, signature binary")
    return stored(rows.withColumn("row_no", F.monotonically_increasing_id()), "sets")


def _is_low(grams: np.ndarray) -> np.ndarray:
    return mix(grams, 1) < np.uint64(int(LOW * (1 << 64)))


def frequent_tokens(docs: DataFrame, width: int, threshold: int) -> np.ndarray:
    """Tokens to be ordered last, sorted: those that more than FREQUENT documents hold.

    Prefixes mostly lie in the low part of the token space, so tokens are counted there first, over all documents.
    Prefixes that reach beyond, as too many of their low tokens are frequent, have their other tokens counted in
    a second pass. If there are more than FREQUENT_LIMIT frequent tokens, the bound is doubled until they fit. The
    order is a total order of all tokens whatever is frequent, so results do not depend on it.
    """

    def counts(known: np.ndarray | None) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(known)  # None, or at most FREQUENT_LIMIT numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for sets in sets_of(batch.column("text"), width):
                    wanted = _is_low(sets.grams)
                    if shared.value is not None:
                        rare = np.bincount(sets.text[wanted & ~_known(sets.grams, shared.value)], minlength=len(sets.n))
                        wanted = ~wanted & (rare < sets.prefix_length(threshold))[sets.text]
                    token, count = np.unique(sets.grams[wanted], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], ["token", "count"])

        rows = docs.select("text").mapInArrow(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("n"))
        return stored(rows.where(F.col("n") > FREQUENT), "frequent")

    def largest(counted: DataFrame) -> np.ndarray:
        bound = FREQUENT
        while counted.where(F.col("n") > bound).count() > FREQUENT_LIMIT // 2:
            bound *= 2
        found = counted.where(F.col("n") > bound).select("token").toPandas()["token"]
        return np.sort(found.to_numpy(np.int64).view(np.uint64))

    low = largest(counts(None))
    return np.sort(np.concatenate([low, largest(counts(low))]))


def _known(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(grams), bool)
    return frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams


def _order_a(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rare tokens of the low part first, then the high part, then frequent tokens; inside each by hash."""
    return (mix(grams, 1) >> np.uint64(1)) | (_known(grams, frequent).astype(np.uint64) << np.uint64(63))


def prefixes(docs: DataFrame, frequent: np.ndarray, width: int, threshold: int) -> DataFrame:
    """(token, node, n, rest, typical): the prefixes under order A; ``rest`` tokens follow. ``typical`` is the share of a
    set's tokens that are frequent, in thousandths. Copies inside one group of texts come once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_LIMIT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()  # at most the rows of a batch
            for sets in sets_of(batch.column("text"), width):
                fresh = np.array([not (v in seen or seen.add(v)) for v in sets.node.tolist()], bool)
                text, token, place = sets.prefix(_order_a(sets.grams, shared.value), threshold)
                keep = fresh[text]
                text, token, place = text[keep], token[keep], place[keep]
                n = sets.n[text].astype(np.int32)
                common = np.bincount(sets.text, _known(sets.grams, shared.value), len(sets.n))
                typical = (1000 * common / np.maximum(sets.n, 1)).astype(np.int32)[text]
                columns = [pa.array(token.view(np.int64)), pa.array(sets.node[text]), pa.array(n)]
                columns += [pa.array((n - place - 1).astype(np.int32)), pa.array(typical)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n", "rest", "typical"])

    return docs.select("text").mapInArrow(run, "token long, node long, n int, rest int, typical int")


def _buckets(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of buckets with several nodes, each node once, with the bucket's most typical node as ``center``.

    Near copies are variants of one text. Where the variants differ their tokens are rare, so the set with the largest
    share of frequent tokens is the one that most others are close to.
    """
    window = Window.partitionBy(*keys).orderBy(F.desc("typical"), "node")
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.select(
        *keys,
        "node",
        "n",
        "rest",
        "typical",
        F.first("node").over(whole).alias("center"),
        F.first("typical").over(whole).alias("center_typical"),
        F.last("node").over(whole).alias("_last"),
        F.lag("node").over(window).alias("_before"),
    )
    several = (F.col("center") != F.col("_last")) & ~F.col("node").eqNullSafe(F.col("_before"))
    return marked.where(several).drop("_last", "_before")


def _reaches(common: Column, a: Column, b: Column, threshold: int) -> Column:
    return 100 * common >= threshold * (a + b - common)


def _thinned(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that pass sizes, orders B and C, and the bound by parts."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = side("a").join(few(pairs), "a")
    both = side("b").join(both, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb, na, nb in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")), strict=True):
                x, y = np.frombuffer(sa, np.uint16), np.frombuffer(sb, np.uint16)
                pa_, pb = x[:PARTS], y[:PARTS]
                full = (pa_ == 65535) | (pb == 65535)
                most = int(np.minimum(pa_, pb).sum(dtype=np.int64)) if not full.any() else min(na, nb)
                good = 100 * min(na, nb) >= threshold * max(na, nb) and 100 * most >= threshold * (na + nb - most)
                cut_a, cut_b = PARTS + (len(x) - PARTS) // 2, PARTS + (len(y) - PARTS) // 2
                good = good and bool(np.isin(x[PARTS:cut_a], y[PARTS:cut_b]).any()) and bool(np.isin(x[cut_a:], y[cut_b:]).any())
                keep.append(good)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.mapInArrow(run, "a long, b long"), "pairs")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs whose sets reach the threshold, compared on the whole sets."""
    passed = _thinned(pairs, nodes, threshold)
    wanted = passed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = few(nodes.join(few(wanted), "node").select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in sets_of(batch.column("text"), width):
                lists = np.split(sets.grams.view(np.int64), sets.first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(sets.node), pa.array(lists, pa.list_(pa.int64()))], ["node", "grams"])

    # A text that repeats an id, or several ids, may give a set twice.
    # Dealt by node once, they are joined from there on both sides.
    sets = texts.select("text").mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])
    side = lambda x: sets.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}"))
    both = passed.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return stored(both.where(_reaches(common, F.size("ga"), F.size("gb"), threshold)).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes that have a link.

    Each round takes the smallest label of the neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of the longest path.
    """
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    edges = stored(both.select("e.a", "e.b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        fresh = stored(step.join(jump, "next", "left").select("node", "old", F.least("next", "further").alias("component")), "labels")
        moved = fresh.where(F.col("old") != F.col("component")).limit(1).count()
        labels = fresh.drop("old")
        if not moved:
            return labels


def near_copies(docs: DataFrame, width: int = 4, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two documents are linked when the shared part of their sets of ``width``-word shingles is at least
    ``threshold`` percent of the joint part; a text with fewer words is one shingle, a null or blank text is
    linked with nothing. ``component_id`` is the smallest doc_id that links reach. Rows that repeat a text share
    a set; a null id takes the smallest id of its component, or stays null.
    """
    docs = docs.select("doc_id", "text")
    rows = _documents(docs, width, threshold)
    reps = rows.where("n > 0").groupBy("node").agg(F.min("row_no").alias("row_no"))
    nodes = stored(rows.join(few(reps.select("row_no")), "row_no").select("node", "n", "signature", "doc_id"), "nodes")
    shared = _buckets(prefixes(docs, frequent_tokens(docs, width, threshold), width, threshold), "token").drop("center", "center_typical")
    # Compatible sizes fall in the same or in neighbouring ranges, so each node stands in two.
    size_range = F.floor(F.log(F.col("n")) / math.log(100 / threshold) + 1e-9)
    sized = shared.select("token", "node", "n", "rest", "typical", F.explode(F.array(size_range, size_range + 1)).alias("sizes"))
    # The rows of a token lie together already, so those of a token and a range of sizes are not moved again.
    buckets = stored(_buckets(sized, "token", "sizes"), "buckets")

    first = buckets.where("node != center").groupBy(F.col("node").alias("b")).agg(F.max_by("center", "center_typical").alias("a"))
    links = _links(first.select("a", "b"), docs, nodes, width, threshold)
    known = components(links)
    at = buckets.join(few(known), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = Window.partitionBy("token", "sizes")
    at = at.withColumn("_lo", F.min("component").over(several)).withColumn("_hi", F.max("component").over(several))
    own = size_range.alias("own")
    at = stored(at.where("_lo != _hi").select("token", "sizes", "node", "n", "rest", "component", own), "open")
    side = lambda x: at.select("token", "sizes", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "rest", "component", "own")])
    most = F.least("a_rest", "b_rest") + 1  # shared tokens, if this is the first that both hold
    fits = (
        (F.col("a_node") < F.col("b_node"))
        & (F.col("a_component") != F.col("b_component"))
        & (F.col("sizes") == F.greatest("a_own", "b_own"))  # the one range in which a pair is taken
        & (100 * F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n"))
        & _reaches(most, F.col("a_n"), F.col("b_n"), threshold)
    )
    rest = side("a").join(side("b"), ["token", "sizes"]).where(fits)
    rest = rest.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    links = links.unionByName(_links(rest, docs, nodes, width, threshold))

    known = components(links)
    ids = rows.groupBy("node", (F.col("n") > 0).alias("_some")).agg(F.min("doc_id").alias("smallest")).where("_some")
    ids = ids.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = ids.groupBy("component").agg(F.min("smallest").alias("component_id"))
    ids = ids.join(best, "component").select("node", "component_id")
    return rows.join(ids, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = 4, threshold: int = 85) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest: one document of each group stays.

    Rows without an id stay; rows that repeat an id and a text are one.
    """
    own = free_name(docs, "_id")
    found = stored(near_copies(docs, width, threshold).select("doc_id", "component_id"), "components")
    found = found.where("doc_id IS NOT NULL")
    gone = few(found.where("doc_id != component_id").select(F.col("doc_id").alias(own)).distinct())
    # A row may repeat an id with another text that is its component's smallest: the id stays with it.
    stays = found.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    gone = few(gone.join(stays, own, "left_anti"))
    repeats = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    return one_of_repeats(docs.join(gone, F.col("doc_id") == F.col(own), "left_anti"), repeats)
