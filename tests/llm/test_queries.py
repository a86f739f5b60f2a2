"""The driver's queries: SQL twins where there are some, and the promised columns."""

from __future__ import annotations

import duckdb
import pytest

from quillon.llm.entry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    of, key = ("embeddings", "vec_id") if "vec_id" in df.columns else ("documents", "doc_id")
    assert {r[key] for r in rows} == {r[key] for r in spark.read.parquet(f"{SF}/{of}.parquet").select(key).collect()}
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        found = con.execute(ORACLE_SQL[name])
        have = [d[0] for d in found.description]
        assert sorted(have) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in have) for r in rows) == sorted(found.fetchall())
