"""The syntactic features of many texts at once, counted over flat arrays of their tokens.

The rules are those of ``tokens.token_relation`` and ``syntax.features_from_tokens``; tests hold both against each other. A text
comes as its sentences, each a list of tokens. What depends on a word alone is looked up once per different word.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stylotrace.fixed_values import SYNTACTIC_FEATURES
from stylotrace.operators import lexicon as lx

TOKENS_AT_ONCE = 1 << 18  # tokens of whole texts that are worked on together, or one text
TEXTS_AT_ONCE = 1 << 11
WORDS_KEPT = 1 << 19  # (language, word) pairs that a worker remembers
PART = 1  # verb forms; 0 is none
CONV = 2


class Words:
    """What the annotator's rules say about words, by language; one for each worker."""

    def __init__(self) -> None:
        rows = lx.lexicon_rows()
        rules = lx.SUFFIX_RULES
        self.tags = sorted({"NOUN", "VERB", "AUX", "PUNCT", "NUM", "SYM"} | {r[2] for r in rows} | {r[1] for r in rules})
        self.code = {tag: k for k, tag in enumerate(self.tags)}
        self.closed = {(lang, word): (self.code[upos], be) for lang, word, upos, be in rows}
        self.suffixes = [(lang, self.code[upos], re.compile(pattern)) for lang, upos, pattern in rules]
        self.forms = [(lang, {"Part": PART, "Conv": CONV}[form], re.compile(pattern)) for lang, form, pattern in lx.VERB_FORM_RULES]
        self.active = {lang: re.compile(pattern) for lang, pattern in lx.ACTIVE_PARTICIPLE.items()}
        self.known: dict[tuple[str, str], tuple[int, bool, int, bool]] = {}

    def look_up(self, lang: str, word: str, punct: bool, number: bool, symbol: bool) -> tuple[int, bool, int, bool]:
        """Tag, whether it is a form of "be", verb form, and whether a participle is active, of a lower-cased word."""
        tag, be = self.closed.get((lang, word), (None, False))
        if punct:
            tag = self.code["PUNCT"]
        elif tag is None and number:
            tag = self.code["NUM"]
        elif tag is None and symbol:
            tag = self.code["SYM"]
        elif tag is None:
            tag = next((t for g, t, rule in self.suffixes if g == lang and rule.search(word)), self.code["NOUN"])
        form = 0
        if tag == self.code["VERB"]:
            form = next((f for g, f, rule in self.forms if g == lang and rule.search(word)), 0)
        return tag, be, form, form == PART and lang in self.active and bool(self.active[lang].search(word))

    def read(self, lang: str, words: list[str], kinds: np.ndarray) -> np.ndarray:
        """``look_up`` of many different words, a row for each; ``kinds`` says punctuation, number and symbol."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        out = []
        for word, kind in zip(words, kinds.tolist(), strict=True):
            found = self.known.get((lang, word))
            if found is None:
                found = self.known[lang, word] = self.look_up(lang, word.lower(), *kind)
            out.append(found)
        return np.array(out, np.int64).reshape(-1, 4)


@lru_cache(maxsize=1)
def _words() -> Words:
    return Words()


def _kinds(words: pa.Array) -> np.ndarray:
    """Whether words are punctuation, numbers in full, or have no letter, digit or underscore."""
    punct = pc.and_(pc.match_substring_regex(words, r"^\p{P}+$"), pc.not_equal(words, "_"))
    lower = pa.array([w.lower() for w in words.to_pylist()], pa.string())
    number = pc.match_substring_regex(lower, r"^\p{N}+$")
    symbol = pc.invert(pc.match_substring_regex(lower, r"[\p{L}\p{N}_]"))
    return np.stack([x.to_numpy(zero_copy_only=False) for x in (punct, number, symbol)], axis=1)


def _n_log_n(texts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Per text the sum of c * log2(c) over its counts, the smallest first, so that equal counts have equal sums."""
    order = np.lexsort((counts, texts))
    c = counts[order].astype(float)
    return np.bincount(texts[order], c * (np.log(c) / np.log(2.0)), n)


def _entropy(total: np.ndarray, sums: np.ndarray) -> np.ndarray:
    some = np.maximum(total, 1).astype(float)
    return np.where(total > 0, np.log(some) / np.log(2.0) - sums / some, 0.0)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b != 0, a / np.where(b != 0, b, 1), 0.0)


def _depths(s: np.ndarray, sentences: int, tag: np.ndarray, comma: np.ndarray, words: Words) -> np.ndarray:
    """The largest depth in each sentence, by the rules of ``tokens.heads_and_depths``; ``s`` is the sentence of each token."""
    content = np.isin(tag, [words.code[t] for t in lx.CONTENT_POS])
    root = np.full(sentences, -1)
    for some in (np.arange(len(s)), np.flatnonzero(content), np.flatnonzero(tag == words.code["VERB"])):
        at = some[np.diff(s[some], prepend=-1) != 0]
        root[s[at]] = at
    c = np.flatnonzero(content)
    first = np.diff(s[c], prepend=-1) != 0
    number = np.arange(len(c))
    seen = number - np.maximum.accumulate(np.where(first, number, 0)) + 1
    is_root = root[s[c]] == c
    restarts = first | is_root | (comma[c - 1] & (s[c - 1] == s[c]) & (c > 0))
    last = np.maximum.accumulate(np.where(restarts, number, 0))
    depth = seen - (seen - ~is_root)[last]
    out = np.zeros(sentences, np.int64)
    if len(c):
        out[s[c][first]] = np.maximum.reduceat(depth, np.flatnonzero(first))
    is_root = root[s] == np.arange(len(s))
    punct = tag == words.code["PUNCT"]
    out[s[punct & ~is_root]] = np.maximum(out[s[punct & ~is_root]], 1)
    f = np.flatnonzero(~content & ~punct & ~is_root)
    if len(f):
        behind = np.searchsorted(c, f)
        at = np.minimum(behind, max(len(c) - 1, 0))
        hangs = (behind < len(c)) & (s[c[at]] == s[f]) if len(c) else np.zeros(len(f), bool)
        below = np.where(hangs, depth[at] + 1 if len(c) else 1, 1)
        starts = np.flatnonzero(np.diff(s[f], prepend=-1))
        out[s[f][starts]] = np.maximum(out[s[f][starts]], np.maximum.reduceat(below, starts))
    return out


def _counted(langs: list[str], texts: pa.ListArray, with_compression: bool) -> dict[str, np.ndarray]:
    """The features of some texts; sums are not rounded yet."""
    words, n = _words(), len(texts)
    t_sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    sentences = texts.flatten()
    s_sizes = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)
    found = sentences.flatten().dictionary_encode()
    word, vocabulary = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
    text_of = np.repeat(np.arange(n), t_sizes)  # of each sentence
    s = np.repeat(np.arange(len(s_sizes)), s_sizes)  # the sentence of each token
    text = text_of[s]
    per_text = lambda at, weights=None: np.bincount(text[at] if weights is None else at, weights, n)

    # Words by language: what is known about each, and which have the same lower case.
    spelled, kinds = vocabulary.to_pylist(), _kinds(vocabulary)
    lemmas: dict[str, int] = {}
    lemma = np.array([lemmas.setdefault(w.lower(), len(lemmas)) for w in spelled], np.int64)[word] if spelled else word
    comma_word = np.array([w == "," for w in spelled], bool)
    listed = {g: k for k, g in enumerate(dict.fromkeys(langs))}
    lang = np.array([listed[g] for g in langs], np.int64)[text]
    facts = np.zeros((len(word), 4), np.int64)
    for g, k in listed.items():
        here = np.flatnonzero(lang == k)
        own, place = np.unique(word[here], return_inverse=True)
        if len(own):
            facts[here] = words.read(g, [spelled[w] for w in own.tolist()], kinds[own])[place]
    tag, be, form, active = facts.T
    punct, comma = tag == words.code["PUNCT"], comma_word[word] if spelled else np.zeros(0, bool)

    near = np.zeros(len(s), bool)
    for back in (1, 2):
        near[back:] |= (be[:-back] > 0) & (s[back:] == s[:-back])
    tokens, plain = per_text(slice(None)), np.flatnonzero(~punct)
    n_words, marks = per_text(plain), per_text(punct)
    full = s_sizes > 0
    k = np.bincount(text_of[full], None, n)
    in_sentence = np.bincount(s[plain], None, len(s_sizes)).astype(float)
    squares = per_text(text_of, in_sentence * in_sentence)
    levels = per_text(text_of, _depths(s, len(s_sizes), tag, comma, words)) if len(s) else np.zeros(n)
    verbs, nouns = (per_text(tag == words.code[t]) for t in ("VERB", "NOUN"))
    passive = (form == PART) & near & (active == 0)

    kind, times = np.unique(text[plain] * max(1, len(lemmas)) + lemma[plain], return_counts=True)
    kind //= max(1, len(lemmas))
    mark, mark_times = np.unique(text[punct] * max(1, len(spelled)) + word[punct], return_counts=True)
    base = len(words.tags)
    tags, tag_text = tag[plain], text[plain]
    by_tag = np.bincount(tag_text * base + tags, None, n * base)
    used = np.flatnonzero(by_tag)
    three = np.flatnonzero(tag_text[2:] == tag_text[:-2])
    seen = np.unique(((tag_text[three] * base + tags[three]) * base + tags[three + 1]) * base + tags[three + 2]) // base**3

    at = np.flatnonzero(comma)
    pair = np.flatnonzero(text[at][1:] == text[at][:-1])
    gap, gap_text = (at[1:] - at[:-1])[pair].astype(float), text[at][1:][pair]
    gaps, gap_sum, gap_squares = (np.bincount(gap_text, w, n) for w in (None, gap, gap * gap))
    mean_gap = _share(gap_sum, gaps)
    gap_std = np.sqrt(np.maximum(_share(gap_squares, gaps) - mean_gap * mean_gap, 0.0))
    sentences_of, words_of = k.astype(float), n_words.astype(float)
    out = {
        "avg_sent_len": _share(words_of, sentences_of),
        "burstiness": _share(np.sqrt(np.maximum(sentences_of * squares - words_of * words_of, 0.0)), sentences_of),
        "punct_entropy": _entropy(marks, _n_log_n(mark // max(1, len(spelled)), mark_times, n)),
        "punct_density": _share(marks, tokens),
        "avg_dep_depth": _share(levels, sentences_of),
        "nv_ratio": nouns / (verbs + 1e-9),
        "ttr": _share(np.bincount(kind, None, n), n_words),
        "hlr": _share(np.bincount(kind[times == 1], None, n), n_words),
        "complexity_ratio": _share(per_text(form > 0), tokens),
        "passive_ratio": _share(per_text(passive), per_text((tag == words.code["VERB"]) | (tag == words.code["AUX"]))),
        "comma_cv": _share(gap_std, mean_gap),
        "unique_trigrams_per_tok": _share(np.bincount(seen, None, n), n_words),
        "pos_entropy": _entropy(n_words, _n_log_n(used // base, by_tag[used], n)),
        "total_tokens": tokens.astype(float),
    }
    if with_compression:
        names = pa.DictionaryArray.from_arrays(pa.array(tags, pa.int32()), pa.array(words.tags)).cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_words)), pa.int32()), names)
        lines = (line.encode() for line in pc.binary_join(lists, " ").to_pylist())
        out["cr_pos"] = np.array([len(zlib.compress(line, 9)) / len(line) if line else 0.0 for line in lines])
    return out


def counted(lang: pa.Array, texts: pa.Array, with_compression: bool = True) -> pa.StructArray:
    """The features of texts of a batch, as many together as have about TOKENS_AT_ONCE tokens; sums are not rounded yet."""
    names = [f for f in SYNTACTIC_FEATURES if with_compression or f != "cr_pos"]
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    langs = lang.to_pylist()
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)))
    tokens = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(texts.flatten()), 0).to_numpy(zero_copy_only=False)))[ends]
    parts, start = [], 0
    while start < len(texts):
        stop = int(np.searchsorted(tokens, tokens[start] + TOKENS_AT_ONCE, "right")) - 1
        stop = min(max(stop, start + 1), start + TEXTS_AT_ONCE, len(texts))
        parts.append(_counted(langs[start:stop], texts.slice(start, stop - start), with_compression))
        start = stop
    columns = [np.concatenate([p[f] for p in parts]) if parts else np.zeros(0) for f in names]
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names)
