"""Line deduplication over overlapping windows of three lines.

Every three consecutive lines of a text (blank ones passed over) are a window with a digest. A window whose
digest occurs more than once in the corpus is kept where it stands first, in order of id and place; its later
occurrences are removed. Windows overlap, so the places they cover are merged into runs of lines.

Only digests move until the end: they are grouped with partial aggregation, joined back to their places, and the
covered places of a document are gathered, which are no more than its lines. A window that a third of all
documents hold is one row on one side of that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylotrace.llm.support import BLANKS, stored

LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _filled(text: Column) -> Column:
    """The lines that are not blank, trimmed, with their places among all lines."""
    trimmed = F.transform(lines_of(text), lambda line, i: F.struct(i.alias("at"), F.trim(F.translate(line, BLANKS, " " * 6)).alias("line")))
    return F.filter(trimmed, lambda x: x["line"] != "")


def windows(docs: DataFrame, width: int = LINES) -> DataFrame:
    """Stored rows (doc_id, version, place, h1, h2): the windows of every text; ``place`` counts filled lines.

    ``version`` tells rows apart that share an id but not a text.
    """
    filled = docs.select("doc_id", F.xxhash64("text").alias("version"), _filled(F.col("text")).alias("lines"))
    places = F.when(F.size("lines") >= width, F.sequence(F.lit(0), F.size("lines") - width)).otherwise(F.array().cast("array<int>"))
    part = lambda i, k: F.get("lines", i + k)["line"]
    hashed = F.transform(
        places,
        lambda i: F.struct(
            i.alias("place"),
            F.xxhash64(*[part(i, k) for k in range(width)]).alias("h1"),
            F.xxhash64(F.lit("second"), *[part(i, k) for k in reversed(range(width))]).alias("h2"),
        ),
    )
    rows = filled.select("doc_id", "version", F.explode(hashed).alias("w"))
    return stored(rows.select("doc_id", "version", "w.place", "w.h1", "w.h2").distinct(), "windows")


def repeated(found: DataFrame) -> DataFrame:
    """Per document the places of windows that stand somewhere before: (doc_id, version, places)."""
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "version", "place")
    first = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"))
    first = first.where("copies > 1").select("h1", "h2", "first")
    later = found.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, width: int = LINES) -> DataFrame:
    """The columns of ``docs`` with ``text`` cleaned, and ``removed``, the runs of lines taken out.

    ``removed`` lists (start, stop) over the lines of the original text, counted from 0, stop excluded; blank lines
    between removed ones go with them. Null texts stay null, texts of fewer than ``width`` filled lines stay as
    they are, rows that repeat an id and a text are one document and treated alike; a null id comes last. A column
    called ``removed`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "removed")]
    # All other columns travel in one struct, so that none can clash with a working column.
    rest = F.struct(F.lit(0), *[F.col(f"`{c}`") for c in kept]).alias("rest")
    order = [c for c in docs.columns if c.lower() not in ("text", "removed")]
    docs = docs.select("doc_id", "text", rest)
    places = repeated(windows(docs.select("doc_id", "text"), width))
    keys = places.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "places")
    both = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version"))
    joined = docs.join(keys, both, "left").withColumn("_filled", _filled(F.col("text")))
    line = lambda i: F.get("_filled", i)["at"]
    # Each window covers its lines; runs of windows that touch are merged. Places are sorted.
    breaks = lambda p, i: (i == 0) | (F.get("places", i - 1) + width < p)
    starts = F.filter(F.transform("places", lambda p, i: F.when(breaks(p, i), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("_starts", starts)
    last = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("places")) - 1
    runs = F.transform(
        "_starts",
        lambda s, k: F.struct(
            line(F.get("places", s)).alias("start"), (line(F.get("places", last(k)) + width - 1) + 1).alias("stop")
        ),
    )
    joined = joined.withColumn("removed", F.coalesce(runs, F.array().cast("array<struct<start:int,stop:int>>")))
    lines = lines_of(F.col("text"))
    n = F.size("removed")
    # What lies between two runs stays: before the first, between neighbours, after the last.
    between = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n),
            lambda k: F.slice(
                "_lines",
                F.coalesce(F.get("removed", k - 1)["stop"], F.lit(0)) + 1,
                F.greatest(
                    F.coalesce(F.get("removed", k)["start"], F.size("_lines"))
                    - F.coalesce(F.get("removed", k - 1)["stop"], F.lit(0)),
                    F.lit(0),
                ),
            ),
        )
    )
    joined = joined.withColumn("_lines", lines)
    text = F.when(n == 0, F.col("text")).otherwise(F.array_join(between, "\n"))
    out = [F.col(f"rest.`{c}`").alias(c) if c in kept else F.col(c) for c in order]
    return joined.select("doc_id", text.alias("text"), "removed", "rest").select(*out, "text", "removed")


def digests(cleaned: DataFrame) -> DataFrame:
    """Counts and digest of cleaned texts."""
    gone = F.aggregate("removed", F.lit(0), lambda n, r: n + r["stop"] - r["start"])
    return cleaned.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_runs"),
        gone.cast("long").alias("lines_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
