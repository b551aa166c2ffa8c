"""Reading and writing corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylotrace.functions import text as X
from stylotrace.sources import csv_ranges


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


MAIN_CORPUS = _schema(
    ("id", T.LongType()), ("text", T.StringType()), ("is_ai", T.BooleanType()), ("is_redacted", T.BooleanType()),
    ("source", T.StringType()), ("topic", T.StringType()), ("temperature", T.DoubleType()), ("top_p", T.DoubleType()),
    ("length_words", T.IntegerType()), ("length_chars", T.IntegerType()),
)
GENERATED_POOL = _schema(
    ("id", T.LongType()), ("text", T.StringType()), ("label", T.StringType()), ("source", T.StringType()),
    ("topic", T.StringType()), ("language", T.StringType()), ("temperature", T.DoubleType()),
    ("top_p", T.DoubleType()), ("length_words", T.IntegerType()), ("length_chars", T.IntegerType()),
    ("redacted", T.BooleanType()),
)
HUMAN_POOL = _schema(("title", T.StringType()), ("text", T.StringType()), ("rubric", T.StringType()))
ACADEMIC_CORPUS = _schema(("text", T.StringType()), ("label", T.StringType()))
QA_CORPUS = _schema(
    ("question", T.StringType()),
    ("human_answers", T.ArrayType(T.StringType())),
    ("chatgpt_answers", T.ArrayType(T.StringType())),
)


def read_corpus(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", by_ranges: bool = True) -> DataFrame:
    """A corpus with a declared schema: headed CSV with quoted multi-line text, or Parquet.

    CSV files are read by byte ranges, so one large file is the work of many tasks. Without ``by_ranges`` Spark's own
    reader takes them, one task for each file: the better choice for very many small files.
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if by_ranges:
        return csv_ranges.read_csv(spark, path, schema)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )


def write_corpus(df: DataFrame, path: str, fmt: str = "csv", bom: bool = False, mode: str = "errorifexists") -> None:
    """Headed CSV or Parquet. With ``bom`` the header of every file starts with the UTF-8 mark."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
        return
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", '""'
    ).csv(path)


def read_qa_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QA_CORPUS).json(path)


def qa_to_rows(qa: DataFrame, min_chars: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per answer: human answers are 0, machine answers 1. Length counts before the trim."""

    def side(answers: str, label: int) -> DataFrame:
        rows = qa.select(*keep, F.explode(answers).alias("text")).where(F.char_length("text") >= min_chars)
        return rows.select(*keep, X.strip(F.col("text")).alias("text"), F.lit(label).alias("is_ai"))

    return side("human_answers", 0).unionByName(side("chatgpt_answers", 1))
