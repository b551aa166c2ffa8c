"""Multi-line CSV by byte ranges against Spark's reader of whole files."""

import random

import pytest

from stylotrace.sources import corpora, csv_ranges


def plain(spark, path, schema):
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


TRICKY = [
    'plain,text,x', '"quoted","a, b","c ""d"" e"', '"line one\nline two\n\nline, four",mid,"end\n"', ",,", '"","",""',
    '5" wide,a "stray" quote,z', '"""start","end""","""\n"""', '"\n\n\n",b,"\n"', 'é,中文,"ü\nß"', '"a\r\nb",c,d',
]


@pytest.mark.parametrize("size", [16, 37, 100, 1 << 20])
def test_equals_the_whole_file_reader_for_cuts_everywhere(spark, tmp_path, size):
    rng = random.Random(4)
    for k in range(2):
        body = [rng.choice(TRICKY) for _ in range(60)]
        (tmp_path / f"{k}.csv").write_bytes(("﻿" * k + "title,text,rubric\n" + "\n".join(body) + "\n" * k).encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(size))
    try:
        got = csv_ranges.read_csv(spark, str(tmp_path), corpora.HUMAN_POOL)
        if size < 1000:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert ordered(got) == ordered(plain(spark, str(tmp_path), corpora.HUMAN_POOL))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_a_field_longer_than_many_ranges(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text('title,text,rubric\n1,"' + "x\n" * 500 + '",z\n2,b,"c"\n', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert ordered(csv_ranges.read_csv(spark, str(path), corpora.HUMAN_POOL)) == [("1", "x\n" * 500, "z"), ("2", "b", "c")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_states():
    after = csv_ranges.state_after
    assert [after(t, 0) for t in ("a,b", '"a', '"a""', '"a"', 'a"b', 'a,"b', '"a","b')] == [0, 1, 1, 0, 0, 1, 1]
    assert [after(t, 1) for t in ("a,b", 'a"', 'a""', 'a","b', 'a",b', '","')] == [1, 0, 1, 1, 0, 1]
    assert csv_ranges.read_csv is not None


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("title,text,rubric\n")
    (tmp_path / "nothing.csv").write_text("")
    assert csv_ranges.read_csv(spark, str(tmp_path), corpora.HUMAN_POOL).count() == 0
