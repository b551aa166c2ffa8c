"""Registered queries of the package against their SQL counterparts on the smallest tables."""

import os

import duckdb
import pytest

from stylotrace.llm.oracle import ORACLE_SQL
from stylotrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(map(tuple, df.collect()), df.columns) == canonical(result.fetchall(), names)


def test_all_thirteen_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
