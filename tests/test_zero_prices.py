"""Queries against their SQL over ticks whose price falls to 0, stays there and comes back, with repeated ticks and last
bars of one tick."""

from __future__ import annotations

import pytest
from compare import assert_same

from loomquant import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def zero_events(tmp_path_factory):
    import duckdb

    where = str(tmp_path_factory.mktemp("zero"))
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT i AS event_id, CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END AS event_type, i % 37 AS user_id,
      TIMESTAMP '2020-01-01' + to_minutes(CAST(20 * (i - CASE WHEN i % 50 IN (12, 13) THEN 2 ELSE 0 END) AS INT)) AS ts,
      CASE WHEN i IN (60, 99, 211, 213) THEN 0e0 WHEN i % 50 IN (12, 13) THEN 20e0 + (i - 2) % 17 ELSE 20e0 + i % 17 END AS value FROM range(402) t(i)""")
    con.execute(f"COPY events TO '{where}/events.parquet' (FORMAT parquet)")
    return where, con


@pytest.mark.parametrize("name", ["filters__cusum", "flagship__tick_bar_risk", "microstructure__trade_lambdas", "weights__by_return", "entropy__tick_features"])
def test_same_rows_with_prices_of_zero(name, spark, zero_events):
    where, con = zero_events
    assert_same(QUERIES[name](spark, where).toPandas(), con.sql(ORACLES[name]).df())
