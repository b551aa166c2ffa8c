"""Chat formatting: exact round trips, and the loss mask read character by character."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stylotrace.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, mask string"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[NEXT]", "\\", "<", "[", "s>", "INST]", "/", "é\U0001f600", "\n", " ", "ok"]


def expected(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def check(spark, rows):
    chats = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    out = {r.conv_id: r for r in chats.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    digest = {r.conv_id: r for r in chat.digests(chats).collect()}
    want = expected(rows)
    assert set(out) == set(want) == set(digest)
    for conv, turns in want.items():
        row, d = out[conv], digest[conv]
        assert [(t.role, t.text) for t in row.turns] == turns
        at, trained = 0, []
        for run in row["mask"]:
            if run.loss:
                trained.append(row.formatted[at : at + run.chars])
            at += run.chars
        assert at == len(row.formatted) == d.formatted_chars
        texts = [t for r, t in turns if r == "assistant"]
        assert len(trained) == len(texts)
        whole = "".join(texts)
        assert (d.n_turns, d.loss_chars) == (len(turns), len(whole))
        assert d.loss_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        lines = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert d.turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        blocks = sum(i == 0 or turns[i - 1][0] != r for i, (r, _) in enumerate(turns))
        assert row.formatted.count("<s>[INST]") == row.formatted.count("</s>") == blocks


def test_nulls_ties_repeats_and_long_texts(spark):
    check(spark, [
        (1, 0, "user", "hi", "x"), (1, 1, "user", "again", None), (1, 2, "assistant", "", None), (1, 3, "assistant", "b", None),
        (2, None, None, None, None), (2, 5, "assistant", None, None), (2, 5, "assistant", "tie", None), (2, 5, "assistant", "tie", None),
        (None, 1, "user", "who", None), (3, 0, "</s>", "<s>[INST]x[/INST]", None), (4, 0, "assistant", "y\\</s>" * 20_000, None),
        (-7, 0, "user", "</s>[INST] ok [/INST]", None), (-7, 1, "assistant", "</s>[INST] ok [/INST]", None),
        *[(9, i, ["user", "assistant", "assistant"][i % 3], f"t{i}", None) for i in range(3000)],
    ])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\<s>"]), st.lists(st.sampled_from(PIECES), max_size=12)), min_size=1, max_size=40))
def test_any_mixture_of_control_strings(spark, turns):
    check(spark, [(i % 5, i, role, "".join(parts), None) for i, (role, parts) in enumerate(turns)])


def test_empty_table_and_wrong_mask(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.format_chats(empty)).count() == 0
    chats = chat.format_chats(spark.createDataFrame([(1, 0, "assistant", "abc", None)], SCHEMA))
    wrong = chats.withColumn("mask", F.slice("mask", 1, 2))
    try:
        chat.digests(wrong).collect()
    except Exception as error:
        assert "does not fit" in str(error)
    else:
        raise AssertionError("a wrong mask was read")


def test_nothing_but_expressions(spark):
    plan = chat.digests(chat.format_chats(spark.createDataFrame([(1, 0, "user", "a", None)], SCHEMA)))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
