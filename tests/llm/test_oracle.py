"""The training-data queries that have SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from tracewell.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(ORACLE[name]).fetchall()
    cols = [d[0] for d in duck.description]
    df = QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    plain = lambda v: round(v, 7) if isinstance(v, float) else v
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(str([plain(v) for v in r]) for r in want) and got
