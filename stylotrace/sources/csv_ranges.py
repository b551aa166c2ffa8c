"""Quoted multi-line CSV read by many tasks.

Whether a line begins inside a quoted field depends on all text before it. Every byte range of a file therefore notes in
which state it ends for both states it could begin in. These small functions, one row for each range, are composed in
file order and tell each range how it begins. In a second pass every range cuts its lines into records on its own. Only
the pieces of records that cross a boundary, at most two for each range, are brought together.

A quote opens a field only where the field begins, so a stray quote inside an unquoted field changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTSIDE, INSIDE = 0, 1
WHOLE, OPENS, ENDS, WITHIN = 0, 1, 2, 3  # a record; its beginning, its end, and text of it that fills a range


def state_after(line: str, state: int) -> int:
    """Whether the text behind a line is inside a quoted field."""
    if '"' not in line:
        return state
    at, n = 0, len(line)
    while True:
        if state == OUTSIDE:
            if at < n and line[at] == '"':
                state, at = INSIDE, at + 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return OUTSIDE
        else:
            at = line.find('"', at)
            if at < 0:
                return INSIDE
            if line.startswith('""', at):
                at += 2
            else:  # the field is closed; what stands before the next comma belongs to it
                at = line.find(",", at) + 1
                if not at:
                    return OUTSIDE
                state = OUTSIDE


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict, list[str]]]:
    """Consecutive lines of one range as (file, start, first row of the run, lines)."""
    for batch in batches:
        files, starts, lines = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        at = 0
        while at < len(lines):
            stop = at + 1
            while stop < len(lines) and starts[stop] == starts[at] and files[stop] == files[at]:
                stop += 1
            yield files[at], starts[at], batch.slice(at, 1), lines[at:stop]
            at = stop


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list[int]] = {}
    for file, start, _, lines in _runs(batches):
        states = held.setdefault((file, start), [OUTSIDE, INSIDE])
        for line in lines:
            if '"' in line:
                states[:] = [state_after(line, s) for s in states]
    names = ["file", "start", "from_outside", "from_inside"]
    rows = [(f, s, *states) for (f, s), states in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), *[pa.int64()] * 3))], names)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines of each range; a record that stays open at its end is given out as a piece."""
    key, state, held, kind, first, out = None, OUTSIDE, [], WHOLE, False, []

    def flush(last_kind: int) -> None:
        nonlocal held, first
        if held:
            text = "\n".join(held)
            if last_kind != WHOLE or text.strip("\r") != "":
                out.append((*key, last_kind, first, text.removesuffix("\r") if last_kind in (WHOLE, ENDS) else text))
                first = False
            held = []

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "start", "kind", "first", "record"]
        )

    for file, start, row, lines in _runs(batches):
        if (file, start) != key:
            flush(OPENS if kind == WHOLE else WITHIN)
            key, state = (file, start), row.column("state")[0].as_py()
            kind, first = (ENDS if state == INSIDE else WHOLE), start == 0
        for line in lines:
            held.append(line)
            state = state_after(line, state)
            if state == OUTSIDE:
                flush(kind)
                kind = WHOLE
        if out:
            yield batch_of(out)
            out.clear()
    flush(OPENS if kind == WHOLE else WITHIN)
    if out:
        yield batch_of(out)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first): the text of every record of all files at ``path``, and whether it is its file's first."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    ranges = lines.mapInArrow(_transitions, "file string, start long, from_outside long, from_inside long")
    # One row for each range of a file, a few numbers in each.
    listed = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "from_outside", "from_inside"))).alias("r"))
    seen = F.aggregate(
        "r",
        F.struct(F.lit(0).cast("long").alias("state"), F.array().cast("array<struct<start:long,state:long>>").alias("out")),
        lambda a, r: F.struct(
            F.when(a["state"] == INSIDE, r["from_inside"]).otherwise(r["from_outside"]).alias("state"),
            F.concat(a["out"], F.array(F.struct(r["start"].alias("start"), a["state"].alias("state")))).alias("out"),
        ),
    )
    states = listed.select("file", F.inline(seen["out"]))
    # One row per range, as small beside its range as a row can be. The join keeps the order of the lines.
    cut = lines.join(F.broadcast(states), ["file", "start"]).mapInArrow(
        _records, "file string, start long, kind int, first boolean, record string"
    )
    pieces = cut.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == OPENS)
    number = F.sum((F.col("kind") == OPENS).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joint = pieces.withColumn("number", number).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("kind") != OPENS).alias("later"), "record"))).alias("p"), F.max("first").alias("first")
    )
    whole = joint.select(F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record"), "first")
    return cut.where(F.col("kind") == WHOLE).select("record", "first").unionByName(whole)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Headed, comma-separated UTF-8 with quoted fields that may hold line breaks; a doubled quote stands for one.

    Columns are taken by position. Records may come in another order than in the file. Lines end in a line feed, with
    or without a carriage return before it.
    """
    rows = records(spark, path)
    if header:
        rows = rows.where(~F.col("first"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(F.from_csv("record", ddl, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
