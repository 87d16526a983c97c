"""Registered queries against their SQL on the smallest given tables."""

import importlib.util
from pathlib import Path

import pytest

from checks.compare import connect, rows_of
from checks.oracle import ORACLE
from checks.queries import QUERIES

DATA = "/root/testdata/sf0.001"
# One or two of every kind; checks.compare runs them all.
CHECKED = [
    "read_headlines_csv",
    "insert_or_ignore",
    "normalize_feed",
    "match_tickers",
    "score_unique_join",
    "asof_forward_orders",
    "daily_features",
    "corr_by_ticker",
    "quintile_lineitem",
    "hit_rate_by_ticker",
    "strip_html_snippet",
    "parse_score",
    "daily_ai_sentiment",
]


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.skipif(not Path(DATA).exists(), reason="given tables absent")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    cur = connect(DATA).execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="given tables absent")
def test_entry(spark):
    path = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())
