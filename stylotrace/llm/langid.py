"""Language identification by multinomial naive Bayes over hashed character n-grams.

Lower-cased letters of a text, with every run of other characters as one blank, give n-grams of one to three
characters; each falls in one of ``buckets`` buckets by a hash. Learning counts buckets by language over all rows to
learn from: every task adds up its own counts in one array per language before anything is shuffled, so a language
or source with a third of all rows is a few rows per task. The logarithms of the smoothed shares form a matrix
(languages by buckets), which is broadcast; its size is checked. Scoring is map-only: the n-grams of many
texts are one sparse batch (text number, bucket), and a text's score by language is a sum over its entries.

Texts are walked in pieces that repeat two characters, so a very long text needs little more memory than itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylotrace.llm.support import stored

ORDERS = 3  # n-grams of one up to three characters
BUCKETS = 1 << 16
SMOOTHING = 0.1  # added to every count
MATRIX_LIMIT = 64 << 20  # bytes of the matrix that is broadcast
PIECE = 1 << 19  # characters worked on at once
UNDETERMINED = "und"
_tables: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters, once for each worker."""
    if not _tables:
        _tables.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _tables[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Languages:
    """Names of the learned languages in order, log shares of the buckets by language, and log priors."""

    names: tuple[str, ...]
    shares: np.ndarray
    priors: np.ndarray


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Characters and text numbers of groups of whole texts, or of pieces of a long one.

    Every text is framed by blanks; letters stay, other characters become blanks, and of neighbouring blanks of a
    text one is left. A piece that goes on repeats the last characters before it, whose number comes third.
    """
    held, size = [], 0
    for number, text in enumerate(texts):
        if not text:
            continue
        framed = f" {text.lower()} "
        if held and size + len(framed) > PIECE:
            yield (*_characters(held), 0)
            held, size = [], 0
        if len(framed) <= PIECE:
            held.append((number, framed))
            size += len(framed)
            continue
        tail = np.empty(0, np.uint32)
        for start in range(0, len(framed), PIECE):
            code, _ = _characters([(number, framed[start : start + PIECE])])
            if len(tail) and tail[-1] == 32 and code[0] == 32:
                code = code[1:]
            code = np.concatenate([tail, code])
            yield code, np.full(len(code), number), len(tail)
            tail = code[1 - ORDERS :]
    if held:
        yield (*_characters(held), 0)


def _characters(held: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(t for _, t in held).encode("utf-32-le", "replace"), np.uint32)
    number = np.repeat(np.array([n for n, _ in held]), [len(t) for _, t in held])
    code = np.where(letters()[points], points, np.uint32(32))
    blank = code == 32
    again = np.zeros(len(code), bool)
    again[1:] = blank[1:] & blank[:-1] & (number[1:] == number[:-1])
    return code[~again], number[~again]


def ngrams(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sparse batch of some texts in parts: (text number, bucket) of each n-gram that holds a letter."""
    for code, number, repeated in _pieces(texts):
        filled = code != 32
        hashed = np.zeros(len(code), np.uint32)
        for n in range(1, min(ORDERS, len(code)) + 1):
            size = len(code) - n + 1
            hashed = (hashed[:size] ^ code[n - 1 :]) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            inside = number[:size] == number[n - 1 :]
            # Blanks have letters as neighbours, so only single blanks hold none.
            if n == 1:
                inside &= filled
            inside[: max(repeated - n + 1, 0)] = False  # these were counted with the piece before
            scrambled = (hashed[inside] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            scrambled ^= scrambled >> np.uint32(16)
            yield number[:size][inside], (scrambled % np.uint32(buckets)).astype(np.int64)


def is_held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, buckets: int = BUCKETS) -> Languages:
    """Learn from all rows of (text, lang) with a language. Rows without a letter count for the priors only."""
    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    rows = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    most = MATRIX_LIMIT // (8 * buckets)
    found = sorted((r.lang, r.n) for r in rows.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} languages: the matrix would exceed {MATRIX_LIMIT} bytes")
    names = [name for name, _ in found]
    place = {name: k for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.array([place[v] for v in batch.column("lang").to_pylist()])
            for number, bucket in ngrams(batch.column("text").to_pylist(), buckets):
                spoken = at[number]
                for k in np.flatnonzero(np.bincount(spoken)).tolist():
                    mine = np.bincount(bucket[spoken == k], minlength=buckets)
                    seen[k] = seen[k] + mine if k in seen else mine
        for k, counts in seen.items():
            some = np.flatnonzero(counts)
            columns = [pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[some])]
            yield pa.RecordBatch.from_arrays(columns, ["language", "bucket", "n"])

    cells = known.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    table = stored(cells, "ngrams").toPandas()  # at most languages x buckets rows, within MATRIX_LIMIT
    counts = np.zeros((len(names), buckets))
    counts[table["language"].to_numpy(np.int64), table["bucket"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
    counts += SMOOTHING
    shares = np.log(counts / counts.sum(axis=1, keepdims=True))
    total = sum(n for _, n in found)
    return Languages(tuple(names), shares, np.array([math.log(n / total) for _, n in found]))


def predict(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but for the text, with ``lang_pred`` and ``score``, its posterior probability.

    A null text, one without a letter, and any text where nothing was learned are ``und`` with score 0. The first
    language by name wins a tie. Columns called ``lang_pred`` or ``score`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MATRIX_LIMIT bytes
    kept = docs.drop("lang_pred", "score")
    passed = [c for c in kept.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        buckets = m.shares.shape[1]
        for batch in batches:
            texts = [t if has_letter(t) else None for t in batch.column(text).to_pylist()]
            value = np.tile(m.priors, (len(texts), 1))
            for number, bucket in ngrams(texts, buckets):
                for k in range(len(m.names)):
                    value[:, k] += np.bincount(number, m.shares[k, bucket], len(texts))
            if m.names:
                best = value.argmax(axis=1)
                score = 1 / np.exp(value - value.max(axis=1, keepdims=True)).sum(axis=1)
                some = [t is not None for t in texts]
                names = [m.names[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some, strict=True)]
                score = np.where(some, score, 0.0)
            else:
                names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            columns = [*[batch.column(c) for c in passed], pa.array(names, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*passed, "lang_pred", "score"])

    types = dict(kept.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in passed)
    return kept.mapInArrow(run, schema + "lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of (doc_id, text, lang).

    Learned from the rows with a language whose id is not held out (crc32 of the id modulo 5 is 0); rows without an
    id are scored like held-out ones, but are marked as not held out, and nothing is learned from them. Repeated rows
    are learned from as often as they stand there, and scored alike.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.where(~is_held_out()))
    scored = predict(rows.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
