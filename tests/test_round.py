"""Recordings whose word error rates lie between two tenths, in D1's and D2's queries and their SQL."""

import duckdb
import pytest
from oracle import same

from utterlake.plans import catalog


@pytest.mark.parametrize("name", ["d1_select_recordings", "d2_build_items", "d2_stored_items"])
def test_tenths_are_rounded_as_sql_does(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range * 3 AS event_id, range % 2 AS user_id, 'view' AS event_type, CASE range % 4 WHEN 0 THEN 1.45 WHEN 1 THEN 1.45 WHEN 2 THEN 0.42 ELSE 3.55 END::DOUBLE AS value FROM range(40)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.SQL[name])
