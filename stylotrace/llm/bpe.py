"""BPE encoding and decoding with forced boundaries.

A boundary between two byte symbols can only vanish by a merge whose token holds these two symbols side by
side. Pairs that stand in no token of the vocabulary therefore mark certain cuts: a word is split at them, the
fragments are encoded independently and their ids concatenated.

The work is map-only: each task reads Arrow batches of texts and adds a column. Nothing is shuffled, so skew
does not arise; texts are walked in pieces that end before a space, so a very long text needs little more
memory than its ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</w>"
VOCABULARY_LIMIT = 64 << 20  # bytes of a vocabulary file; it is broadcast
CACHED_BYTES = 64 << 20  # of each of the two caches of a Python worker, about
CACHED_LENGTH = 48
ENTRY_BYTES = 250  # what a cached string costs beside its characters and ids, about
HASHED_IDS = 1 << 20  # ids that are decoded and hashed at a time
PIECE = 1 << 20  # characters walked at a time
BATCH_IDS = 4 << 20  # ids of one outgoing batch
NONE = 1 << 60

# The white space of the format, and what Unicode 16 has beyond the tables of this Python.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEW_LETTERS = (
    "\u1c89\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85"
    "\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1"
    "\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff"
    "\U0001e5d0-\U0001e5ed\U0001e5f0"
)
NEW_NUMBERS = (
    "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79"
    "\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
)
NEW_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
# End of fixed values.


def _ranges(kind: str) -> str:
    """A character class of all code points whose general category starts with ``kind``."""
    out, start, last = [], None, None
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind:
            if start is None:
                start = c
            last = c
        elif start is not None:
            out.append(f"{chr(start)}-{chr(last)}")
            start = None
    if start is not None:
        out.append(f"{chr(start)}-{chr(last)}")
    return "".join(out)


@dataclass(frozen=True)
class BpeModel:
    """A vocabulary with word ends: tokens by id, merges by rank, special tokens by text."""

    tokens: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]
    special: tuple[tuple[str, int], ...]
    letters: str
    numbers: str


def load_model(path: str) -> BpeModel:
    """Read a tokenizer file of the word-end BPE kind (the driver reads it; tasks get it by broadcast)."""
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_LIMIT + 1)
    if len(raw) > VOCABULARY_LIMIT:
        raise ValueError(f"the vocabulary exceeds {VOCABULARY_LIMIT} bytes")
    doc = json.loads(raw)
    model = doc["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
        raise ValueError("this operator needs a BPE vocabulary with word ends")
    special = {t["content"]: t["id"] for t in doc["added_tokens"]}
    tokens = dict(model["vocab"]) | special
    by_id = [""] * (max(tokens.values()) + 1)
    for token, i in tokens.items():
        by_id[i] = token
    missing = [c for c in byte_symbols() for s in (c, c + END) if s not in tokens]
    if missing:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    classes = _ranges("L") + NEW_LETTERS, _ranges("N") + NEW_NUMBERS
    return BpeModel(tuple(by_id), tuple(merges), tuple(special.items()), *classes)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class _Known(dict):
    """Packed ids of the strings met so far, bounded by bytes.

    Half of the bound is for the strings met lately. When these fill it, they take the place of the ones before, which
    are looked up once more before they are forgotten, so frequent strings stay.
    """

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.held, self.before = make, 0, {}

    def __missing__(self, key: str) -> bytes:
        packed = self.before.get(key)
        if packed is None:
            packed = self.make(key)
        if len(key) <= CACHED_LENGTH:
            self.held += ENTRY_BYTES + len(key) + len(packed)
            if self.held > CACHED_BYTES // 2:
                self.before = dict(self)
                self.clear()
                self.held = ENTRY_BYTES + len(key) + len(packed)
            self[key] = packed
        return packed


_latest: list = [None, None]


def encoder_of(model: BpeModel) -> Encoder:
    """The encoder of this Python worker; workers serve many tasks."""
    if _latest[0] is not model:
        _latest[:] = model, Encoder(model)
    return _latest[1]


class Encoder:
    """Encodes whole texts."""

    def __init__(self, model: BpeModel) -> None:
        ids = {t: i for i, t in enumerate(model.tokens)}
        symbols = byte_symbols()
        self.inner = [ids[c] for c in symbols]
        self.final = [ids[c + END] for c in symbols]
        self.merged = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(model.merges)}
        self.result = [ids[a + b] for a, b in model.merges]
        names = {t for t, _ in model.special}
        joinable = set()
        for token in model.tokens:
            if token and token not in names:
                at = [ids[c] for c in token.removesuffix(END)]
                if token.endswith(END):
                    at[-1] = ids[token.removesuffix(END)[-1] + END]
                joinable.update(a << 32 | b for a, b in zip(at, at[1:]))
        # The rank of the merge of two byte symbols, NONE if only other merges bring them together. Pairs
        # without an entry stand in no token: a certain cut.
        self.pairs = {p: self.merged.get(p, NONE) for p in joinable}
        self.special = {t: np.int32(i).tobytes() for t, i in model.special}
        self.cut_special = re.compile(f"({'|'.join(map(re.escape, self.special))})") if self.special else None
        letters, numbers, short = model.letters, model.numbers, "|'(?:s|t|re|ve|m|ll|d)|"
        self.words = re.compile(f"[{letters}]+{short}[{numbers}]|[^{WHITE_SPACE}{letters}{numbers}]+")
        self.ascii_words = re.compile(f"[a-z]+{short}[0-9]|[^\t-\r a-z0-9]+")
        self.newer = re.compile(f"[{''.join(map(chr, NEW_LOWER))}]")
        self.space = re.compile(f"[{WHITE_SPACE}]+")
        self.numbers = pa.array([str(i) for i in range(len(model.tokens))])
        self.runs = _Known(self._run)
        self.known_words = _Known(lambda word: np.asarray(self.encode_word(word), np.int32).tobytes())

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        if not text:
            return b""
        if not any(t in text for t in self.special):
            return self._plain(text)
        parts = self.cut_special.split(text)
        return b"".join(self.special[p] if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)

    def _plain(self, text: str) -> bytes:
        out, start = [], 0
        while start < len(text):
            stop = start + PIECE
            if stop < len(text):
                stop = text.find(" ", stop)
                stop = len(text) if stop < 0 else stop
            piece = text[start:stop]
            # Python counts four control characters as white space that the format does not.
            runs = self.space.split(piece) if any(c in piece for c in "\x1c\x1d\x1e\x1f") else piece.split()
            out.append(b"".join(map(self.runs.__getitem__, runs)))
            start = stop
        return b"".join(out)

    def _run(self, text: str) -> bytes:
        """Ids of text without white space."""
        if text.isascii():
            found = self.ascii_words.findall(text.lower())
        else:
            # Letters are lowered one by one, so a final sigma has no form of its own.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if self.newer.search(text):
                text = text.translate(NEW_LOWER)
            found = self.words.findall(text)
        return b"".join(map(self.known_words.__getitem__, found))

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        out, start, ranks, pairs = [], 0, [], self.pairs
        for i in range(1, len(symbols)):
            rank = pairs.get(symbols[i - 1] << 32 | symbols[i])
            if rank is None:
                out += self._merge(symbols[start:i], ranks)
                start, ranks = i, []
            else:
                ranks.append(rank)
        return out + self._merge(symbols[start:], ranks)

    def _merge(self, ids: list[int], ranks: list[int]) -> list[int]:
        """Apply the lowest-ranked merge, leftmost first, until none is left."""
        if len(ids) > 100:
            return self._merge_long(ids)
        merged = self.merged
        while ranks and (rank := min(ranks)) != NONE:
            at = ranks.index(rank)
            ids[at : at + 2] = [self.result[rank]]
            del ranks[at]
            if at:
                ranks[at - 1] = merged.get(ids[at - 1] << 32 | ids[at], NONE)
            if at < len(ranks):
                ranks[at] = merged.get(ids[at] << 32 | ids[at + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for fragments of any length."""
        ids, n = list(ids), len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (rank := self.merged.get(ids[a] << 32 | ids[b])) is not None:
                heapq.heappush(heap, (rank, a, b, ids[a], ids[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, a, b, left, right = heapq.heappop(heap)
            if ids[a] != left or ids[b] != right or after[a] != b:
                continue
            ids[a], ids[b] = self.result[rank], -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [i for i in ids if i >= 0]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], values], [*keep, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in df.schema if f.name != name], T.StructField(name, kind)])


def encode(df: DataFrame, model: BpeModel, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``, the ids of the whole text.

    Null and empty texts get an empty list. A column already called ``out`` is replaced, all others pass
    through; repeated rows are encoded each. Lone special-token strings become their ids. An empty table gives
    an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY_LIMIT bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            start, packed, total = 0, [], 0
            for i, value in enumerate(batch.column(text)):
                packed.append(encoder.encode(value.as_py()))
                total += len(packed[-1]) // 4
                if total >= BATCH_IDS or i == batch.num_rows - 1:
                    offsets = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
                    values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                    yield _with_column(batch.slice(start, i + 1 - start), out, lists)
                    start, packed, total = i + 1, [], 0

    return df.mapInArrow(run, _schema(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model: BpeModel, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the tokens of the ids, special ones included, joined by a space (the format names no decoder).

    A null list counts as empty. Ids outside the vocabulary are an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value.tokens, pa.string())
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                lists = part.column(ids)
                if lists.null_count:
                    lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
                lengths = pc.list_value_length(lists)
                offsets = np.concatenate([[0], np.cumsum(lengths.to_numpy())]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(offsets), table.take(lists.flatten()))
                yield _with_column(part, out, pc.binary_join(words, " "))

    return df.mapInArrow(run, _schema(df, out, T.StringType()))


def round_trip(df: DataFrame, model: BpeModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, decoded and digested in one pass.

    The same as ``digests`` over ``encode`` and ``decode``, but neither ids nor decoded texts leave the task, and a
    long text is decoded and hashed piece by piece, so memory is bounded by the ids of one text. Null and empty
    texts have no ids.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY_LIMIT bytes
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        tables = encoder.numbers, pa.array(shared.value.tokens, pa.string())

        def digests_of(held: list[bytes]) -> list[tuple[int, str, str]]:
            """Of some short texts together, or piece by piece of a long one: number of ids and both digests."""
            out = [(len(h) // 4, hashlib.sha256(), hashlib.sha256()) for h in held]
            ids = pa.array(np.frombuffer(b"".join(held), np.int32))
            ends = np.cumsum([0, *[n for n, _, _ in out]], dtype=np.int64)
            if len(held) == 1:
                cuts = np.append(np.arange(0, max(len(ids), 1), HASHED_IDS), len(ids))
            else:
                cuts = ends
            for k, table in enumerate(tables):
                for at in range(len(cuts) - 1) if len(held) == 1 else [None]:
                    part = cuts if at is None else cuts[at : at + 2]
                    offsets = pa.array((part - part[0]).astype(np.int32))
                    words = table.take(ids.slice(part[0], part[-1] - part[0]))
                    for j, joined in enumerate(pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ")):
                        if at:
                            out[0][1 + k].update(b" ")
                        out[j][1 + k].update(joined.as_buffer())
            return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in out]

        for batch in batches:
            done, held, size = [], [], 0
            for value in batch.column(text):
                packed = encoder.encode(value.as_py())
                if held and size + len(packed) > 4 * HASHED_IDS:
                    done += digests_of(held)
                    held, size = [], 0
                held.append(packed)
                size += len(packed)
            if held:
                done += digests_of(held)
            sizes, of_ids, of_text = ([r[k] for r in done] for k in range(3))
            columns = [batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(id_col, text).mapInArrow(run, out)


def digests(coded: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Number of ids, digest of the ids as decimal numbers joined by a space, and digest of the decoded text."""
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )
