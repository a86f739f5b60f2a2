"""What only larger or odd tables show: orders of summation, ties, plans that grow with the square of the input."""

from __future__ import annotations

import math
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillon.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def tables(root, **made) -> str:
    """A folder of sf0.001's tables, some of them replaced."""
    for f in os.listdir(SF):
        if f.removesuffix(".parquet") not in made:
            os.symlink(f"{SF}/{f}", f"{root}/{f}")
    for name, df in made.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return str(root)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_match_content_meets_one_vector_alone(spark):
    df = QUERIES["sql_match_content"](spark, SF)
    assert "Join" not in plan(df)  # laterally: every distinct vector of the index against every row
    assert df.count()


def _awkward() -> tuple[float, float, float]:
    """Three values whose average in their order and in reverse lie on two sides of a whole number."""
    for a in range(1, 400):
        for b in range(1, 400):
            c = 900 - a - b
            if c > 0:
                v = a / 100, b / 100, c / 100
                if math.floor((v[0] + v[1] + v[2]) / 3) != math.floor((v[2] + v[1] + v[0]) / 3):
                    return v
    raise AssertionError


@pytest.mark.parametrize("name", ["asof_prior", "rank_history30", "rank_latest_prev"])
def test_daily_averages_are_added_up_in_the_order_of_events(spark, tmp_path, name):
    v = _awkward()
    at = datetime(2024, 1, 5)
    rows = [(2 - i, at, 1, "view", x) for i, x in enumerate(reversed(v))] + [(3, at, 2, "view", None)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1)
    got = {r.user_id: r for r in QUERIES[name](spark, tables(tmp_path, events=events)).collect()}
    want = math.floor((v[0] + v[1] + v[2]) / 3)
    col = {"asof_prior": "prior_position", "rank_history30": "history", "rank_latest_prev": "position"}[name]
    assert str(got[1][col]) == str(want)
    assert got[2][col] in (None, "")


@pytest.fixture
def odd(spark, tmp_path):
    """Tables whose events have days without any value and times that are null, and a connection to the same rows in DuckDB."""
    import duckdb

    day = lambda i: datetime(2024, 1, i) if i else None
    seen = [(1, 3, 1.5), (1, 5, None), (1, 22, 7.0), (2, 4, None), (2, 6, None), (3, 0, 9.0), (3, 2, 4.0), (3, 8, 2.0), (3, 25, None), (4, 0, 3.0)]
    rows = [(i, day(d), u, "view", v) for i, (u, d, v) in enumerate(seen)]
    root = tables(tmp_path, events=spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{root}/events.parquet/*.parquet')")
    return root, con


def same_rows(spark, odd, name) -> bool:
    root, con = odd
    found = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    assert sorted((tuple(r) for r in QUERIES[name](spark, root).select(*cols).collect()), key=str) == want
    return bool(want)


def test_asof_prior_goes_back_to_a_known_position(spark, odd):
    assert same_rows(spark, odd, "asof_prior")


def test_history_without_positions_is_null_and_undated_ones_come_last(spark, odd):
    assert same_rows(spark, odd, "rank_history30")


def test_latest_positions_of_odd_days(spark, odd):
    assert same_rows(spark, odd, "rank_latest_prev")


def test_cache_lookup_keeps_the_age_of_large_keys(spark, tmp_path):
    days = [(4_310_136, datetime(1997, 12, 2)), (9, datetime(1997, 12, 3)), (12, datetime(1997, 12, 3)), (8_000_001, datetime(1997, 12, 2))]
    orders = spark.createDataFrame([(k, 1 if k < 8_000_000 else 2, t) for k, t in days], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp")
    customer = spark.createDataFrame([(1,), (2,)], "c_custkey bigint")
    got = QUERIES["cache_lookup"](spark, tables(tmp_path, orders=orders, customer=customer)).collect()
    assert [tuple(r) for r in got] == [(1, 12)]  # 30 days old is too old, whatever the key


def whole_plan(spark, df) -> str:
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        return plan(df)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


@pytest.mark.parametrize(("name", "step"), [("currency_notes", "regexp_extract_all"), ("media_probe", "from_json"), ("final_gate", "parsejson"), ("model_answers", "regexp_replace(text"), ("brief_errors", "parsejson")])
def test_a_row_is_parsed_once(spark, name, step):
    text = whole_plan(spark, QUERIES[name](spark, SF)).lower()
    assert text.count(step) <= 6, text.count(step)  # once for each form of the row


def test_lint_holds_one_automaton_a_task(spark, monkeypatch):
    from quillon.operators import dictionary, documents

    monkeypatch.setattr(dictionary, "PART", 7)
    docs = spark.createDataFrame([(f"d{i}.md", "", 2) for i in range(60)] + [(None, "", 2)], "name string, content string, level int")
    lines = spark.createDataFrame([(f"- see d{i}.md and d{i + 1}.md",) for i in range(0, 50, 5)] + [(None,)], "line string")
    found = documents.lint(docs, "name", "content", "level", lines, ("x/",))
    named = {f"d{i + j}.md" for i in range(0, 50, 5) for j in (0, 1)}
    assert {r.name for r in found.collect() if r.name} == {f"d{i}.md" for i in range(60)} - {n for n in named}
    chains = [node for node in plan(found).split("Union")[1:]]
    assert chains  # a part's scan beside another's, not on top of it


def test_search_multiplies_a_slice_of_a_part_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from quillon.operators import vector_index
    from quillon.operators.vector import ROWS, Best, unit_rows

    rng = np.random.default_rng(1)
    v, q = unit_rows(rng.normal(size=(5 * ROWS + 3, 4))), unit_rows(rng.normal(size=(9, 4)))
    whole, cut = Best(q, 6), Best(q, 6)
    ids = pa.array(range(len(v)))
    whole.offer(v, ids)
    for lo in range(0, len(v), ROWS):
        cut.offer(v[lo : lo + ROWS], ids.slice(lo, ROWS))
    assert all(np.array_equal(a, b) if isinstance(a, np.ndarray) else a.equals(b) for a, b in zip(whole.found(), cut.found(), strict=True))
    assert vector_index.ROWS == ROWS  # before: a whole part at once
