"""BPE against the library whose format it reads, on texts made to be awkward."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stylotrace.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, token_ids string, extra int"


@pytest.fixture(scope="module")
def model():
    return bpe.load_model(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnop'.,!? \n\t0123456789éßΑΣσ中文  ́\U0001f600AEZ<|>"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(200)]
    out += ["", " ", "It's WE'LL they're 's't", "a<|endoftext|>B <|startoftext|><|endoftext|>", "ẞ İ é Å"]
    out += ["a" * 50_000, "x7" * 3_000, "ba" * 20_000 + " " + "!" * 5_000, "word " * 300_000, "힣가" * 400]
    return out


def test_encode_and_decode_equal_the_library(spark, model, library):
    values = texts()
    df = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(values)], SCHEMA).repartition(3)
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(df, model), model).collect()}
    assert len(rows) == len(values)
    for i, text in enumerate(values):
        want = library.encode(text, add_special_tokens=False).ids
        assert rows[i].token_ids == want, text[:80]
        assert rows[i].decoded == library.decode(want, skip_special_tokens=False)
        assert rows[i].extra == 1


def test_every_code_point(model, library):
    encoder = bpe.Encoder(model)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 4096):
        text = " ".join(f"a{chr(c)}." for c in points[start : start + 4096])
        got = memoryview(encoder.encode(text)).cast("i").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, hex(points[start])


def test_cuts_are_certain(model):
    """Cutting at impossible pairs and not cutting at all give the same ids."""
    cutting, whole = bpe.Encoder(model), bpe.Encoder(model)
    whole.pairs = type("Everything", (), {"get": lambda self, pair: whole.merged.get(pair, bpe.NONE)})()
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioxqzj7é中!") for _ in range(rng.randrange(1, 90))) for _ in range(500)]
    assert [cutting.encode_word(w) for w in words] == [whole.encode_word(w) for w in words]
    assert len(cutting.pairs) < 512 * 512 / 4


def test_nulls_repeats_and_empty_tables(spark, model):
    df = spark.createDataFrame([(None, None, None, None), (1, "hi", None, None), (1, "hi", None, None)], SCHEMA)
    rows = bpe.digests(bpe.decode(bpe.encode(df, model), model)).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 1, 1]
    assert bpe.decode(bpe.encode(df.limit(0), model), model).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")
    assert bpe.decode(nulls, model).collect()[0].decoded == ""


def test_a_vocabulary_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        bpe.load_model(public_tokenizers.path("byte_bpe_50k.json"))


def test_one_pass_equals_encode_and_decode(spark, model):
    values = [*texts(), None, "word " * 100_000 + "a<|endoftext|>b"]
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(values)] + [(3, values[3], "x", 1)] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = bpe.digests(bpe.decode(bpe.encode(df, model), model))
    got = bpe.round_trip(df, model)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert bpe.round_trip(df.limit(0), model).count() == 0


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 10_000)
    known = bpe._Known(lambda key: key.encode())
    for k in range(1000):
        assert known[f"w{k}"] == f"w{k}".encode()
        assert (len(known) + len(known.before)) * bpe.ENTRY_BYTES <= 10_000
    assert known["w999"] == b"w999"


@pytest.mark.parametrize("pieces", [1, 7, 1000])
def test_digests_do_not_depend_on_pieces(spark, model, monkeypatch, pieces):
    monkeypatch.setattr(bpe, "HASHED_IDS", pieces)
    rows = [(i, t, "x", 1) for i, t in enumerate(["", "a b c", "word " * 50, "<|endoftext|>", "x", None, "é!" * 30])]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = bpe.digests(bpe.decode(bpe.encode(df, model), model))
    assert sorted(map(tuple, bpe.round_trip(df, model).collect())) == sorted(map(tuple, want.collect()))
