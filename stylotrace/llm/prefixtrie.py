"""The trie of conversation prefixes, from adaptive radix trees over turn ids.

A turn's id is the first 16 bytes of a digest of its role and text, so equal turns have equal ids without a dictionary
to join and texts never move. A conversation's key is its ids one after another, most significant byte first.
Distinct keys are range-partitioned; every range becomes one adaptive radix tree, whose nodes grow from 4 over 16 and
48 to 256 children and hold the bytes of unbranched paths. Byte depths that are multiples of the width of an id are
nodes of the trie, all others only branch.

Neighbouring ranges share the nodes above the longest common prefix of the last key of one and the first key of the
next. A range counts such a node's part: its members there, children and weights that it is the first to hold. The
parts add up, also over whole subtrees, so one small aggregate over the shared nodes completes the trie. A prefix that
a third of all conversations share is one row for each range it spans.

A conversation is one row, 16 bytes of key and 8 of size a turn. The ids of conversations with equal sequences are
hashed as a stream of sorted rows, never held together.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.llm.support import few, stored

WIDTH = 16  # bytes of a turn id
TREE_BYTES = 4 << 20  # key bytes of one tree, about
HEAD = 8  # the most turns that the rebuilt conversations below take from another one
NOTHING = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of an adaptive radix tree: the bytes of its path, the key that ends here, and its children by byte.

    Up to 4, then up to 16 children lie in the order of their bytes beside these; up to 48 are found through a
    table of 256 places; beyond that the table holds the children themselves.
    """

    __slots__ = ("prefix", "value", "some", "size", "bytes", "children")

    def __init__(self, prefix: bytes, value: int, some: int) -> None:
        self.prefix, self.value, self.some = prefix, value, some  # some: any key that runs through the node
        self.size, self.bytes, self.children = 4, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.size == 256:
            return self.children[byte]
        if self.size == 48:
            place = self.bytes[byte]
            return self.children[place - 1] if place else None
        place = self.bytes.find(byte)
        return self.children[place] if place >= 0 else None

    def add(self, byte: int, child: Node) -> None:
        """Add a child under a byte that has none, in the next larger layout if this one is full."""
        if self.size < 256 and len(self.children) == self.size:
            self._grow()
        if self.size == 256:
            self.children[byte] = child
        elif self.size == 48:
            self.children.append(child)
            self.bytes[byte] = len(self.children)
        else:
            place = bisect_left(self.bytes, byte)
            self.bytes.insert(place, byte)
            self.children.insert(place, child)

    def _grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            table = bytearray(256)
            for place, byte in enumerate(self.bytes):
                table[byte] = place + 1
            self.size, self.bytes = 48, table
        else:
            self.children = [self.children[place - 1] if place else None for place in self.bytes]
            self.size, self.bytes = 256, bytearray()

    def in_order(self) -> list[Node]:
        if self.size == 256:
            return [c for c in self.children if c is not None]
        if self.size == 48:
            return [self.children[place - 1] for place in self.bytes if place]
        return self.children

    def split(self, length: int) -> None:
        """Keep the first bytes of the path; what follows becomes the only child."""
        below = Node(self.prefix[length + 1 :], self.value, self.some)
        below.size, below.bytes, below.children = self.size, self.bytes, self.children
        byte, self.prefix, self.value = self.prefix[length], self.prefix[:length], -1
        self.size, self.bytes, self.children = 4, bytearray(), []
        self.add(byte, below)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


def insert(root: Node | None, key: bytes, value: int) -> Node:
    """Put a key into the tree and return its root; ``value`` is the number of the key."""
    if root is None:
        return Node(key, value, value)
    node, depth = root, 0
    while True:
        path = node.prefix
        if key.startswith(path, depth):
            depth += len(path)
        else:
            same = common(key[depth : depth + len(path)], path)
            node.split(same)
            depth += same
        if depth == len(key):
            node.value = value
            return root
        child = node.find(key[depth])
        if child is None:
            node.add(key[depth], Node(key[depth + 1 :], value, value))
            return root
        node, depth = child, depth + 1


def trie_nodes(root: Node, width: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """The nodes at multiples of ``width``, parents first and in key order: parent, depth, ending key or -1, any key."""
    parent, depth, ends, some = [], [], [], []
    stack = [(root, 0, -1)]
    while stack:
        node, start, above = stack.pop()
        stop = start + len(node.prefix)
        for at in range(-(-start // width), stop // width + 1):
            parent.append(above)
            depth.append(at)
            ends.append(-1)
            some.append(node.some)
            above = len(parent) - 1
        if node.value >= 0:
            ends[above] = node.value
        stack.extend((child, stop + 1, above) for child in reversed(node.in_order()))
    return parent, depth, ends, some


def _chain(key: bytes, depth: int) -> list[bytes]:
    """Digests of the key's prefixes of 0 to ``depth`` turns."""
    state, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        if d:
            state.update(key[(d - 1) * WIDTH : d * WIDTH])
        out.append(state.copy().digest())
    return out


BUILT = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
     ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
     ("node", pa.binary()), ("parent", pa.binary())]
)
BUILT_SQL = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, node binary, parent binary"
)


def build(rows: pa.Table) -> pa.Table:
    """The nodes of one range of keys.

    ``rows`` has key, sizes, n, conv_id, ends_sha256, and on every row the number of turns that the first key shares with
    the range before and the last key with the range behind (-1 without one). ``node`` names nodes that other ranges
    hold too, ``parent`` names a parent of that kind.
    """
    rows = rows.sort_by("key")
    keys, sizes = rows.column("key").to_pylist(), rows.column("sizes").to_pylist()
    n, first, digest = (rows.column(c).to_pylist() for c in ("n", "conv_id", "ends_sha256"))
    before, behind = rows.column("before")[0].as_py(), rows.column("behind")[0].as_py()
    root = None
    for value, key in enumerate(keys):
        root = insert(root, key, value)
    parent, depth, ends, some = trie_nodes(root, WIDTH)
    total = len(parent)

    # Nodes 0 to ``before`` lead to the first key and belong to a range before this one.
    weight = [sizes[some[t]][depth[t] - 1] if depth[t] else 0 for t in range(total)]
    members = [n[e] if e >= 0 else 0 for e in ends]
    least = [first[e] if e >= 0 else None for e in ends]
    children, below, leaves, saved = [0] * total, [0] * total, [0] * total, [0] * total
    last = total - 1  # the last key ends in the last node
    for t in range(last, -1, -1):
        goes_on = t == last and behind == depth[t]
        leaves[t] += not below[t] and not goes_on
        mine = t > before
        saved[t] += (members[t] - mine) * weight[t]
        if (p := parent[t]) >= 0:
            below[p] += 1
            children[p] += mine
            members[p] += members[t]
            least[p] = least[t] if least[p] is None else min(least[p], least[t])
            leaves[p] += leaves[t]
            saved[p] += saved[t]
    names: list[bytes | None] = [None] * total
    names[: before + 1] = _chain(keys[0], before) if before >= 0 else []
    chain, t = _chain(keys[-1], behind) if behind >= 0 else [], last
    while t >= 0:
        if depth[t] <= behind:
            names[t] = chain[depth[t]]
        t = parent[t]
    columns = [
        least, depth, [least[p] if p >= 0 else None for p in parent], members, children, leaves, saved,
        [digest[e] if e >= 0 else None for e in ends], names, [names[p] if p >= 0 else None for p in parent],
    ]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BUILT, strict=True)], schema=BUILT)


# Sequences -------------------------------------------------------------------------------------


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal id of a turn; the length of the role keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation as (id, size), by turn with null first, ties by role, then id.

    ``size`` is the number of UTF-8 bytes of the text. Null roles and texts are empty; rows without a conv_id belong to
    no conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            role.alias("role"), turn_id(role, text).alias("id"), F.octet_length(text).cast("long").alias("size"),
        ).alias("t"),
    )
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(found: DataFrame) -> DataFrame:
    """Sequences whose first turns are those of the conversation whose id is the next multiple of 5 towards 0."""
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(9)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 5
    heads = found.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD).alias("heads"))
    both = found.withColumns({"base": base, "head": head}).join(heads, "base", "left")
    empty = F.slice("turns", 1, 0)
    turns = F.concat(
        F.coalesce(F.slice("heads", F.lit(1), F.col("head")), empty), F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns"), F.lit(1)))
    )
    return both.select("conv_id", turns.alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """(sequence, n, conv_id, ends_sha256) of each distinct sequence: its conversations' number, smallest id and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, first, state = None, 0, None, None

        def row() -> pa.RecordBatch:
            columns = [[name], [n], [first], [state.hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sequence", "n", "conv_id", "ends_sha256"])

        for batch in batches:
            names, ids = batch.column("sequence").to_pylist(), batch.column("conv_id").to_pylist()
            start, done = 0, []
            while start < len(names):
                stop = start + 1
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                if names[start] != name:
                    if name is not None:
                        done.append(row())
                    name, n, first, state = names[start], 0, ids[start], hashlib.sha256()
                state.update((("," if n else "") + ",".join(map(str, ids[start:stop]))).encode())
                n += stop - start
                start = stop
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if name is not None:
            yield row()

    ordered = members.repartition("sequence").sortWithinPartitions("sequence", "conv_id")
    return ordered.mapInArrow(run, "sequence string, n long, conv_id long, ends_sha256 string")


def prefix_trie(found: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), one row each; ``turns`` lists (id, size) and ``conv_id`` is unique.

    conv_id is a node's smallest member, depth its number of turns, parent_conv_id its parent's conv_id (null for the
    root); n_convs counts members, n_children children, n_leaves the childless nodes of the subtree, the node included;
    saved_tokens adds up, over the subtree, (members - 1) times the size of the last turn; ends_sha256 digests the ids
    of conversations that end there, ascending and joined by commas. Conversations without turns end in the root.
    An empty table has no nodes.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = stored(found.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "keys")
    ends = _ends(rows.select(F.sha2("key", 256).alias("sequence"), "conv_id"))
    distinct = stored(rows.join(ends.drop("sequence"), "conv_id"), "sequences")
    size = distinct.agg(F.sum(F.octet_length("key") + WIDTH).alias("n")).first()["n"] or 0
    ranged = distinct.repartitionByRange(1 + int(size) // tree_bytes, "key").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")

    # One row for each range; what two neighbours share is counted in turns.
    bounds = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("part")
    bounds = bounds.select("part", "low", "high", F.lag("high").over(order).alias("above"), F.lead("low").over(order).alias("next"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, above, behind = (batch.column(c).to_pylist() for c in ("low", "high", "above", "next"))
            turns = lambda a, b: [-1 if x is None else common(x, y) // WIDTH for x, y in zip(a, b, strict=True)]
            columns = [batch.column("part"), pa.array(turns(above, low), pa.int32()), pa.array(turns(behind, high), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "before", "behind"])

    edges = few(bounds.mapInArrow(shared, "part int, before int, behind int"))
    built = stored(ranged.join(edges, "part").groupBy("part").applyInArrow(lambda group: build(group.drop(["part"])), BUILT_SQL), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = built.where("node IS NOT NULL").groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.max("parent").alias("parent")
    )
    whole = stored(whole, "shared")
    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent"]
    inner = built.where("node IS NULL").select(*names, "parent_conv_id")
    every = inner.unionByName(whole.select(*names, F.lit(None).cast("long").alias("parent_conv_id")))
    above = few(whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("known")))
    return every.join(above, "parent", "left").select(
        "conv_id", "depth", F.coalesce("known", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """The trie of rebuilt conversations, from rows (conv_id, turn, role, text). Other columns are not looked at."""
    found = stored(sequences(conversations.select("conv_id", "turn", "role", "text")), "turns")
    return prefix_trie(rebuilt(found), tree_bytes)
