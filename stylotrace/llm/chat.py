"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of the same role become one block, whose
texts are joined; the blocks are concatenated. Texts and roles are escaped reversibly, so a text that holds
the template's own control strings neither opens nor closes anything. The loss mask is a list of runs over the
formatted string (characters, trained or not), in which each text of the trained role is one run.

A conversation is one row of the output and is put together in one task; every step is linear in its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A block is ``opening role heading text (between text)* closing``. No control string holds a backslash."""

    opening: str = "<s>[INST]"
    heading: str = "[/INST]"
    between: str = "[NEXT]"
    closing: str = "</s>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[NEXT]")
    trained: str = "assistant"

    def _inside(self) -> tuple[str, str]:
        """Patterns of what stands before and after the place where a control string is broken."""
        first = "".join(sorted({re.escape(c[0]) for c in self.control}))
        return f"(?<=[{first}])", f"(?={'|'.join(sorted(re.escape(c[1:]) for c in self.control))})"

    def escape(self, text: Column) -> Column:
        """Double every backslash, then break each control string by a single one after its first character."""
        before, after = self._inside()
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), before + after, r"\\")

    def unescape(self, text: Column) -> Column:
        before, after = self._inside()
        return F.replace(F.regexp_replace(text, before + r"\\" + after, ""), F.lit("\\\\"), F.lit("\\"))


PLAIN = ChatTemplate()


def format_chats(turns: DataFrame, template: ChatTemplate = PLAIN) -> DataFrame:
    """(conv_id, formatted, mask) with one row per conversation of (conv_id, turn, role, text).

    Turns are ordered by turn, then role and text; a null turn comes first. Null roles and texts count as empty,
    a null conv_id is a conversation of its own, repeated rows are turns of their own. ``mask`` lists
    (chars, loss) for consecutive runs of ``formatted``.
    """
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    opens = lambda t, i: (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
    starts = F.filter(
        F.transform("turns", lambda t, i: F.when(opens(t, i), i)), lambda i: i.isNotNull()
    )
    blocks = F.transform(
        "starts",
        lambda first, k: F.slice("turns", first + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - first),
    )
    role = lambda block: template.escape(F.get(block, F.lit(0))["role"])
    texts = lambda block: F.transform(block, lambda t: template.escape(t["text"]))
    written = F.transform(
        "blocks",
        lambda b: F.struct(
            F.concat(F.lit(template.opening), role(b), F.lit(template.heading)).alias("head"),
            texts(b).alias("texts"),
            (F.get(b, F.lit(0))["role"] == template.trained).alias("loss"),
        ),
    )
    run = lambda chars, loss: F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))
    quiet = F.lit(False)
    block_runs = lambda b: F.concat(
        F.flatten(
            F.transform(
                b["texts"],
                lambda t, i: F.array(
                    run(F.when(i == 0, F.length(b["head"])).otherwise(len(template.between)), quiet),
                    run(F.length(t), b["loss"]),
                ),
            )
        ),
        F.array(run(F.lit(len(template.closing)), quiet)),
    )
    block_text = lambda b: F.concat(b["head"], F.array_join(b["texts"], template.between), F.lit(template.closing))
    return (
        grouped.withColumn("starts", starts)
        .withColumn("blocks", blocks)
        .withColumn("written", written)
        .select(
            "conv_id",
            F.array_join(F.transform("written", block_text), "").alias("formatted"),
            F.flatten(F.transform("written", block_runs)).alias("mask"),
        )
    )


def read_turns(formatted: Column, template: ChatTemplate = PLAIN) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    blocks = F.filter(F.split(formatted, re.escape(template.closing)), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.split(block, re.escape(template.heading), 2)
        name = F.substring(F.get(head, F.lit(0)), len(template.opening) + 1, 1 << 30)
        return F.transform(
            F.split(F.get(head, F.lit(1)), re.escape(template.between)),
            lambda t: F.struct(template.unescape(name).alias("role"), template.unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns_of))


def trained_text(formatted: Column, mask: Column, template: ChatTemplate = PLAIN) -> Column:
    """All text under the loss mask, unescaped and joined.

    The string is cut at its control strings, which gives its runs again; a mask whose runs have other lengths
    does not belong to it and is an error.
    """
    marks = [template.opening, template.heading, template.between, template.closing]
    ahead = "|".join(f"(?={re.escape(m)})" for m in marks if m != template.heading)
    behind = "|".join(f"(?<={re.escape(m)})" for m in marks if m != template.opening)
    parts = F.filter(F.split(formatted, f"{ahead}|{behind}"), lambda p: p != "")
    runs = F.filter(mask, lambda r: r["chars"] > 0)
    pairs = F.zip_with(parts, runs, lambda p, r: F.struct(p.alias("p"), r.alias("r")))
    fits = F.forall(pairs, lambda x: F.coalesce(F.length(x["p"]) == x["r"]["chars"], F.lit(False)))
    text = F.array_join(
        F.transform(F.filter(pairs, lambda x: x["r"]["loss"]), lambda x: template.unescape(x["p"])), ""
    )
    return F.when(fits, text).otherwise(F.raise_error(F.lit("the mask does not fit the text")))


def digests(chats: DataFrame, template: ChatTemplate = PLAIN) -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""
    read = chats.select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted"), template).alias("turns"),
        trained_text(F.col("formatted"), F.col("mask"), template).alias("trained"),
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
