"""K-d sharding: near equal bytes, gapless slots, equal texts together, and the same again at another partitioning."""

import random
import zlib

from stylotrace.llm import kdshard

SCHEMA = "doc_id long, text string, lang string, slot string"


def corpus(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = None if i % 97 == 5 else "copy " * 30 if i % 3 == 0 else "é" * int(rng.paretovariate(1.2) * 20 % 3000)
        rows.append((i, text, ["en", "de", "fr", None, ""][len(text or "") % 5], "clash"))
    return rows


def check(rows, got, shards):
    assert len(got) == len(rows)
    largest = max(r.size for r in got)
    held, slots = {}, {}
    text = {r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}
    for r in got:
        held[r.shard] = held.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None:
            assert r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id])
    assert set(held) == set(range(shards))
    fair = sum(held.values()) / shards
    assert all(abs(b - fair) <= 6 * largest for b in held.values()), (fair, largest, held)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_forty_shards(spark):
    rows = corpus(12_000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = kdshard.kd_shards(df.repartition(5), 40).collect()
    check(rows, got, 40)
    again = kdshard.kd_shards(df.repartition(2), 40).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    shards = {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(b"copy " * 30)
    split = [len(s) for c, s in shards.items() if c not in (hot, zlib.crc32(b"")) and len(s) > 1]
    assert len(split) <= 40 and 5 <= len(shards[hot]) <= 25


def test_target_bytes_small_and_empty_tables(spark):
    rows = corpus(300)
    df = spark.createDataFrame(rows, SCHEMA)
    total = sum(len((r[1] or "").encode()) + 16 for r in rows)
    assert kdshard.kd_shards(df, target_bytes=total // 6).select("shard").distinct().count() == 6
    odd = spark.createDataFrame([(None, None, None, None), (1, "a", "en", None), (1, "a", "en", None)], SCHEMA)
    assert sorted(r.size for r in kdshard.kd_shards(odd, 40).collect()) == [16, 17, 17]
    assert kdshard.kd_shards(df.limit(0), 40).count() == 0
