"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, the field needs labelled words. Words of labelled documents are counted in distinct
contexts (the words before and after), so that copies of a document count once. A word that stands in toxic
documents far more often than chance allows is an offending word there; all other words are not. On windows of words tagged
so the field learns weights of word, prefix and suffix features and of the transitions between the two tags. It
then tags every whole text: forward and backward messages give each word's marginal, a document's score is a
calibrated function of its strongest marginal, and runs of words above one half are its offending spans.

Learning uses a bounded, hash-drawn sample of labelled rows (``Limits``); scoring is map-only, with the model broadcast.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylotrace.llm.support import few, stored


@dataclass(frozen=True)
class Limits:
    """Bounds of what is learned from; drawn by hash."""

    documents: int = 16384
    windows: int = 8192  # of each kind: offending ones, clean ones that hold such a word, other clean ones
    words: int = 2000  # offending words at most, the most certain ones


WINDOW = 32
DIMENSIONS = 1 << 18
LEAST_RATIO = 8.0  # how many times as frequent in toxic contexts an offending word has to be
FLOOR = -12.0
PREFIXES = (3, 4, 5, 6, 7, 8)
PER_WORD = 2 + len(PREFIXES)
KNOWN_WORDS = 200_000
LONGEST = 64  # characters of a run that count as one word
SIGN = re.compile(r"[\W_]+")
NO_SIGN = re.compile(r"[^\W_]")


def clean(run: str) -> str:
    """The word in a run of non-blank characters: lower case, without signs at its ends."""
    if NO_SIGN.match(run) is None:
        run = run[found.end() :] if (found := SIGN.match(run)) else run
    if run and NO_SIGN.match(run[-1]) is None:
        run = run[: len(run) - SIGN.match(run[::-1]).end()]
    return run.lower()


def places(text: str) -> Iterator[tuple[int, int]]:
    """Where the words of a text stand: runs of non-blank characters.

    A longer run than LONGEST, as in scripts without blanks, is read through windows of half that length, each
    half over the one before, so every character is in a word.
    """
    half = LONGEST // 2
    for run in re.finditer(r"\S+", text):
        start, stop = run.span()
        if stop - start <= LONGEST:
            yield start, stop
        else:
            for at in range(start, stop - half // 2, half // 2):
                yield at, min(at + half, stop)


def runs_of(text: str) -> list[str]:
    """The pieces of a text that ``places`` names."""
    runs = text.split()
    if max(map(len, runs), default=0) <= LONGEST:
        return runs
    return [text[a:b] for a, b in places(text)]


def features(word: str) -> list[int]:
    """Hashed features of a word. Its neighbours act through the transitions."""
    raw, at, crc = word.encode(), 0, zlib.crc32(b"p")
    plain = len(raw) == len(word)
    out = [zlib.crc32(b"bias") % DIMENSIONS, zlib.crc32(raw, zlib.crc32(b"w")) % DIMENSIONS]
    for k in PREFIXES:  # each prefix continues the one before
        crc, at = zlib.crc32(raw[at:k] if plain else word[at:k].encode(), crc), k
        out.append(crc % DIMENSIONS)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of the tag 'offending' against 'other', log transitions, and the calibration of scores."""

    weights: np.ndarray
    transitions: np.ndarray  # [from, to] with 0 other, 1 offending; other-other is 0
    curve: tuple[float, ...] = (-4.0, 1.0, 0.0, 0.0)  # constant, peak, log of expected words, log of words


def messages(unary: np.ndarray, first: np.ndarray, count: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Log odds of the marginals of many sequences laid end to end.

    With two tags a message is one number, the ratio of its two entries. All sequences take each step together.
    """
    forward, backward = unary.astype(np.float64), np.zeros(len(unary))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    oo, ot, to, tt = transitions[0, 0], transitions[0, 1], transitions[1, 0], transitions[1, 1]
    alive = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), side="right")
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(ot, r + tt) - np.logaddexp(oo, r + to)
    last = first + count - 1
    for t in range(1, len(alive)):
        at = last[: alive[t]] - t
        r = backward[at + 1] + unary[at + 1]
        backward[at] = np.logaddexp(to, r + tt) - np.logaddexp(oo, r + ot)
    return forward + backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_field(windows: list[list[str]], tags: list[list[int]], rounds: int = 60, penalty: float = 1e-3) -> Field:
    """Maximise the penalised likelihood of the tags by adaptive gradient steps over all windows."""
    count = np.array([len(w) for w in windows], np.int64)
    first = np.cumsum(count) - count
    ids = np.array([features(w) for window in windows for w in window], np.int64).reshape(-1, PER_WORD)
    gold = np.array([t for row in tags for t in row], np.float64)
    inner = np.ones(len(gold), bool)
    inner[first[count > 0]] = False
    pair = np.flatnonzero(inner)
    weights, transitions = np.zeros(DIMENSIONS), np.zeros((2, 2))
    seen_w, seen_t = np.full(DIMENSIONS, 1e-6), np.full((2, 2), 1e-6)
    share = max(gold.mean(), 1e-3) if len(gold) else 1e-3
    weights[features("")[0]] = math.log(share / (1 - share))
    for _ in range(rounds if len(gold) else 0):
        unary = weights[ids].sum(axis=1)
        odds = messages(unary, first, count, transitions)
        gradient = np.bincount(ids.ravel(), np.repeat(gold - _sigmoid(odds), PER_WORD), DIMENSIONS) / len(windows)
        gradient -= penalty * weights
        seen_w += gradient**2
        weights += 0.5 * gradient / np.sqrt(seen_w)
        step = _pair_gradient(unary, odds, gold, pair, transitions) / len(windows) - penalty * transitions
        step[0, 0] = 0
        seen_t += step**2
        transitions += 0.1 * step / np.sqrt(seen_t)
    return Field(weights.astype(np.float32), transitions)


def _pair_gradient(unary, odds, gold, pair, transitions) -> np.ndarray:
    """Observed minus expected tag pairs. The pair marginals follow from those of the second word of each pair."""
    out, p, before = np.zeros((2, 2)), _sigmoid(odds), pair - 1
    # P(first | second): the forward ratio of the first word, weighed by the transition into the second.
    ahead = _forward_ratio(unary, pair, transitions)
    for b in (0, 1):
        q = _sigmoid(ahead[before] + transitions[1, b] - transitions[0, b])
        second = p[pair] if b else 1 - p[pair]
        for a in (0, 1):
            seen = ((gold[before] == a) & (gold[pair] == b)).sum()
            out[a, b] = seen - (second * (q if a else 1 - q)).sum()
    return out


def _forward_ratio(unary, pair, transitions) -> np.ndarray:
    first = np.flatnonzero(~np.isin(np.arange(len(unary)), pair))
    count = np.diff(np.append(first, len(unary)))
    forward = unary.copy()
    for t in range(1, int(count.max(initial=0))):
        at = first[count > t] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(transitions[0, 1], r + transitions[1, 1]) - np.logaddexp(0.0, r + transitions[1, 0])
    return forward


# Learning from labelled documents --------------------------------------------------------------


def is_held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def training_texts(docs: DataFrame, labels: DataFrame, limits: Limits) -> DataFrame:
    """(text, toxic, draw) of at most ``limits.documents`` labelled rows that are not held out, drawn by hash."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~is_held_out()).select("doc_id", "toxic").distinct()
    draw = F.md5(F.concat(F.lit("toxicity"), F.col("doc_id").cast("string")))
    drawn = known.withColumn("draw", draw).orderBy("draw", "toxic").limit(limits.documents)
    drawn = few(drawn.withColumnRenamed("doc_id", "_id"))
    return stored(docs.join(drawn, F.col("doc_id") == F.col("_id")).select("text", "toxic", "draw"), "training")


def offending_words(texts: DataFrame, limits: Limits) -> set[str]:
    """Words whose contexts are toxic far more often than those of all words: a likelihood ratio test over words."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = [clean(r) for r in runs_of(text or "")]
                rows = {(w, zlib.crc32(f"{a} {b}".encode())) for a, w, b in zip(["", *words], words, [*words[1:], ""]) if w}
                columns = [pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([toxic] * len(rows), pa.int32())], ["word", "context", "toxic"])

    rows = texts.select("text", F.col("toxic").cast("int")).mapInArrow(contexts, "word string, context long, toxic int")
    words = rows.distinct().groupBy("word").agg(
        F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")
    )
    words = stored(words, "words")
    total = words.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    if not total[0] or not total[1] or not total[2]:
        return set()
    share, n = total[1] / (total[1] + total[2]), F.col("a") + F.col("b")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    evidence = part(F.col("a"), share) + part(F.col("b"), 1 - share)
    ratio = ((F.col("a") + 0.5) / total[1]) / ((F.col("b") + 0.5) / total[2])
    found = words.where((ratio >= LEAST_RATIO) & (evidence >= math.log(total[0]) + 3))
    best = found.orderBy(evidence.desc(), "word").limit(limits.words)  # at most limits.words rows come back
    return {r.word for r in best.select("word").collect()}


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Field:  # noqa: B008
    """Learn a field from (doc_id, text) and (doc_id, toxic). Without labels of both kinds nothing offends."""
    texts = training_texts(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), limits)
    bad = offending_words(texts, limits)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic, draw in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "draw")), strict=True):
                words = [clean(r) for r in runs_of(text or "")]
                rows = []
                for k in range(0, len(words), WINDOW):
                    part = words[k : k + WINDOW]
                    tags = [int(toxic == 1 and w in bad) for w in part]
                    kind = 0 if any(tags) else 3 if toxic else 1 if bad.intersection(part) else 2
                    rows.append((part, tags, kind, f"{zlib.crc32(f'{draw}{k}'.encode()):08x}{draw}"))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("words", "tags", "kind", "draw"), r)) for r in rows], schema)

    schema = pa.schema([("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())), ("kind", pa.int32()), ("draw", pa.string())])
    cut = stored(texts.mapInArrow(windows, "words array<string>, tags array<int>, kind int, draw string"), "windows")
    kinds = [cut.where(f"kind = {kind}").orderBy("draw").limit(limits.windows) for kind in range(3)]
    drawn = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        field = fit_field([r["words"] for r in rows], [r["tags"] for r in rows])
        columns = [pa.array([field.weights.tobytes()]), pa.array([field.transitions.tobytes()])]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "transitions"])

    # One task learns from at most three times limits.windows windows.
    row = drawn.coalesce(1).mapInArrow(learn, "weights binary, transitions binary").first()
    if row is None:
        return Field(np.zeros(DIMENSIONS, np.float32), np.zeros((2, 2)))
    field = Field(np.frombuffer(row.weights, np.float32), np.frombuffer(row.transitions, np.float64).reshape(2, 2))
    return calibrate(field, texts)


def calibrate(field: Field, texts: DataFrame) -> Field:
    """Fit a logistic curve from a document's measures to its label, on the drawn documents (within ``Limits``)."""
    rows = score(texts.select("text", "toxic"), field).select("peak", "expected", "words", "toxic").toPandas()
    if rows["toxic"].nunique() < 2:
        return field
    x, y = design(*(rows[c].to_numpy(np.float64) for c in ("peak", "expected", "words"))), rows["toxic"].to_numpy(np.float64)
    w = prior = np.array(field.curve)

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.05 * ((w - prior) ** 2).sum())

    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * (w - prior))
        while cost(w + step) > cost(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
    return Field(field.weights, field.transitions, tuple(w.tolist()))


def design(peak: np.ndarray, expected: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(peak), peak, np.log(expected + 1e-3), np.log1p(words)], axis=1)


# Scoring ---------------------------------------------------------------------------------------


class _Unary(dict):
    """Log odds of the words met so far, bounded."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def of(self, runs: list[str]) -> np.ndarray:
        """Log odds of the words of a text; those that are new are weighed together."""
        fresh = [r for r in set(runs) if r not in self]
        if len(self) + len(fresh) > KNOWN_WORDS:
            self.clear()
            fresh = list(set(runs))
        if fresh:
            ids = np.array([features(clean(r)) for r in fresh], np.int64)
            self.update(zip(fresh, self.weights[ids].sum(axis=1).tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, runs), np.float32, len(runs))


def _spans(text: str, odds: np.ndarray) -> list[dict[str, int]]:
    """Character ranges of neighbouring offending words."""
    out, last = [], -2
    for k, (start, stop) in enumerate(places(text)):
        if odds[k] > 0:
            if last == k - 1:
                out[-1]["stop"] = stop
            else:
                out.append({"start": start, "stop": stop})
            last = k
    return out


def score(docs: DataFrame, field: Field) -> DataFrame:
    """The columns of ``docs`` but for text, with peak (log odds of the strongest marginal), expected
    (sum of marginals), words, score and spans (character ranges) of each whole text.

    Null and blank texts have no word: the lowest peak, no spans. Columns of
    these names are replaced. Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # DIMENSIONS weights
    names = ["peak", "expected", "words", "score", "spans"]
    kept = docs.drop(*names)
    passed = [c for c in kept.columns if c != "text"]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        known = _Unary(f.weights)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts = [known.of(runs_of(t)) for t in texts]
            count = np.array([len(p) for p in parts], np.int64)
            first = np.cumsum(count) - count
            odds = messages(np.concatenate([np.empty(0, np.float32), *parts]), first, count, f.transitions)
            peak = np.full(len(texts), FLOOR)
            some = np.flatnonzero(count)
            if len(some):
                peak[some] = np.clip(np.maximum.reduceat(odds, first[some]), FLOOR, -FLOOR)
            sums = np.concatenate([[0.0], np.cumsum(_sigmoid(odds))])
            expected = sums[first + count] - sums[first]
            value = _sigmoid(design(peak, expected, count.astype(np.float64)) @ np.array(f.curve))
            found = [_spans(t, odds[a : a + n]) if top > 0 else [] for t, a, n, top in zip(texts, first, count, peak, strict=True)]
            columns = [*[batch.column(c) for c in passed], pa.array(peak), pa.array(expected), pa.array(count), pa.array(value), pa.array(found, spans)]
            yield pa.RecordBatch.from_arrays(columns, [*passed, *names])

    types = dict(kept.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in passed)
    return kept.mapInArrow(run, schema + "peak double, expected double, words long, score double, spans array<struct<start:int,stop:int>>")


def toxicity(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, score, predicted, spans) for every row of (doc_id, text), learned from what is not held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, limits))
    return scored.select(
        "doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans",
    )
