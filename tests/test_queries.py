"""Some registered queries on the smallest tables: split keys give the plain result, and results
agree with SQL. scripts/check_oracles.py compares all of them."""

import os
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import rows

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "scripts"))

from check_oracles import normal  # noqa: E402

from furlong import catalog  # noqa: E402
from furlong.session import TABLES  # noqa: E402

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables not present")

SPLIT = ["paragraph_sections", "pnl_streaks", "asof_market_inclusive"]
AGAINST_SQL = ["q_min_slice", "perf_summary", "psi_numeric", "id_priority_chain", "prefix_match", "coalesce_upsert", "roc_auc"]


@pytest.mark.parametrize("name", SPLIT)
def test_split_keys_give_the_same_result(spark, name):
    build = catalog.queries()[name]
    plain = rows(build(spark, DIRECTORY))
    spark.conf.set("spark.furlong.hotKeyRows", "4")
    spark.conf.set("spark.furlong.hotKeyCheckBytes", "0")
    try:
        assert rows(build(spark, DIRECTORY)) == plain
    finally:
        spark.conf.unset("spark.furlong.hotKeyRows")
        spark.conf.unset("spark.furlong.hotKeyCheckBytes")


@pytest.mark.parametrize("name", AGAINST_SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIRECTORY}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert normal(catalog.queries()[name](spark, DIRECTORY).toPandas()) == normal(want)


def test_every_query_has_a_name_of_its_own_and_an_sql_counterpart_known(spark):
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 180
