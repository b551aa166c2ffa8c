"""The prefix trie against brute force, the radix tree against a dictionary, over few and many ranges."""

import hashlib
import random
import zlib

import pytest

from stylotrace.llm import prefixtrie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(sequences):
    """{conv_id: ((role, text), ...)} -> rows, by looking at every prefix of every conversation."""
    nodes = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for prefix in nodes:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    rows = []
    for prefix, members in nodes.items():
        inside = [p for p in nodes if p[: len(prefix)] == prefix]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in inside if p)
        ends = ",".join(str(c) for c in sorted(members) if len(sequences[c]) == len(prefix))
        rows.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(children.get(prefix, [])),
            sum(p not in children for p in inside), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def plain_rebuilt(rows):
    turns = {}
    # Ties go by role, then by the digest of role and text.
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((turn is not None, turn or 0, role, digest(role, text), text))
    own = {c: tuple((r, t) for _, _, r, _, t in sorted(x)) for c, x in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, ())[:h] + own[c][h:]
    return out


def conversations(seed, n, texts=4):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 2, 3, 4, 6, 12])):
            role = ["user", "assistant"][turn % 2]
            rows.append((c, turn if turn else None, role, f"t{rng.randrange(texts)} é" if rng.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("tree_bytes", [1 << 20, 2000, 100])
def test_against_brute_force(spark, tree_bytes):
    rows = conversations(1, 150)
    rows += [(400 + k, t, "system", "the same") for k in range(60) for t in range(3)]  # a large group of copies
    rows += [(700, t, "user", f"x{t}") for t in range(300)] + [(701, 0, None, None), (None, 1, "user", "lost"), (702, 5, "a", "b"), (702, 5, "a", "b")]
    rows += [(703, None, "b", "y"), (703, None, "a", "z"), (703, None, "a", "é")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pt.conversation_trie(df, tree_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("tree_bytes", [1 << 20, 64])
def test_sequences_that_are_prefixes_of_each_other(spark, tree_bytes):
    turns = [("r", f"{k % 3}") for k in range(9)]
    sequences = {c: tuple(turns[: c % 10]) for c in range(40)} | {c: tuple(turns[3:]) for c in range(50, 60)}
    ident = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[: 2 * pt.WIDTH]
    rows = [(c, [(ident(*t), len(t[1])) for t in x]) for c, x in sequences.items()]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<id:string,size:long>>").repartition(4)
    assert sorted(map(tuple, pt.prefix_trie(df, tree_bytes).collect()), key=repr) == plain_trie(sequences)


def test_tree_holds_what_was_put_in():
    rng = random.Random(3)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(4))) for _ in range(3000)}
    keys |= {bytes([5, k]) for k in range(0, 90, 3)}
    keys |= {b"\0" * 50, b"\0" * 49 + b"\1", b"path" * 20, b"path" * 20 + b"x"}
    order = list(keys)
    rng.shuffle(order)
    root = None
    for value, key in enumerate(order):
        root = pt.insert(root, key, value)
    found, sizes, stack = [], set(), [(root, b"")]
    while stack:
        node, above = stack.pop()
        path = above + node.prefix
        if node.value >= 0:
            assert order[node.value] == path
            found.append(path)
        assert order[node.some].startswith(path)
        sizes.add(node.size)
        labels = [b for b in range(256) if node.find(b) is not None]
        assert [node.find(b) for b in labels] == node.in_order()
        assert len(labels) <= node.size and (len(labels) > 1 or node.value >= 0)  # paths are compressed
        stack.extend((node.find(b), path + bytes([b])) for b in reversed(labels))
    assert found == sorted(keys)
    assert sizes == {4, 16, 48, 256}


def test_only_turn_depths_are_nodes():
    root = None
    for value, key in enumerate([b"aaaabbbb", b"aaaabbbc", b"aaaa", b"aabb", b""]):
        root = pt.insert(root, key, value)
    parent, depth, ends, _ = pt.trie_nodes(root, 4)
    assert (parent, depth, ends) == ([-1, 0, 1, 1, 0], [0, 1, 2, 2, 1], [4, 2, 0, 1, 3])


def test_empty_table_and_clashing_names(spark):
    rows = conversations(5, 30)
    names = ["key", "sizes", "node", "parent", "base", "heads", "sequence", "part", "turns"]
    wide = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + "".join(f", {c} string" for c in names))
    assert sorted(map(tuple, pt.conversation_trie(wide).collect()), key=repr) == plain_trie(plain_rebuilt(rows))
    assert pt.conversation_trie(wide.limit(0)).count() == 0
