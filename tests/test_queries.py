"""The registry, and a few of its queries against their oracle."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallyforge.plans.registry import TABLES
from tallyforge.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert len(ORACLES) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["tpch_q03", "tpch_q13", "tpch_q16", "join_full", "grouping_sets", "window_rank", "recursive_reachability", "date_part_week", "dml_merge"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def test_count_min_with_many_keys(spark, tmp_path):
    """More keys than the sketch has counters to themselves, and rows without a key."""
    path = tmp_path / "lineitem.parquet"
    duckdb.sql(f"COPY (SELECT CASE WHEN i % 100 > 0 THEN i * i % 80021 END AS l_suppkey FROM range(120000) r(i)) TO '{path}' (FORMAT parquet)")
    df = QUERIES["count_min"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}')")
    asked = con.execute(ORACLES["count_min"]).fetchall()
    assert len(asked) > 30000
    assert sorted(map(str, map(tuple, df.select("l_suppkey", "n").collect()))) == sorted(map(str, asked))
