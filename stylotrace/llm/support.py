"""What several operators share: stored intermediate tables and the words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylotrace.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and continue from there.

    Every later job then sees the same rows, recomputes nothing, and survives the loss of an executor.
    """
    path = shared_dir(df.sparkSession, purpose) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores behind it until ``df`` has no column of that name (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def without_blanks(text: Column) -> Column:
    """The text without the six ASCII blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


FEW_ROWS = 1 << 19


def few(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows are counted to be few; else as it is, for a shuffled join."""
    df = stored(df, "few")
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def one_of_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of those that repeat an id and a text; ``repeats`` holds the ids that may be repeated.

    Only rows with such an id are moved to be compared.
    """
    repeats = stored(repeats, "repeats")
    n = repeats.count()
    if not n:
        return docs
    own = free_name(docs, "_id")
    listed = repeats.toDF(own)
    listed = F.broadcast(listed) if n <= FEW_ROWS else listed
    same = F.col(id_col).eqNullSafe(F.col(own))
    again = docs.join(listed, same, "left_semi").dropDuplicates([id_col, text])
    return docs.join(listed, same, "left_anti").unionByName(again)
