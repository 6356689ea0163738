import duckdb
import pytest

from loomspark.plans import queries as Q


def rows_of(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name, table, columns", [
    ("interval_merge", "lineitem", "select (k // 9)::bigint as l_orderkey, case when k % 5 > 0 then (k * 7 % 11)::int end as l_linenumber, case when k % 4 > 0 then (k * 13 % 50)::double end as l_quantity from range(900) r(k)"),
    ("session_islands", "events", "select k::bigint as event_id, (k // 9)::bigint as user_id, case when k % 5 > 0 then timestamp '2024-01-01' + interval (k * 7919 % 7200) second end as ts from range(900) r(k)"),
])
def test_nulls_as_in_sql(spark, tmp_path, name, table, columns):
    con = duckdb.connect()
    con.sql("set threads = 1")  # the SQL numbers the islands of equal rows in any order
    con.sql(f"create view {table} as {columns}")
    con.sql(f"copy {table} to '{tmp_path}/{table}.parquet'")
    assert rows_of(Q.QUERIES[name](spark, str(tmp_path)).collect()) == rows_of(con.sql(Q.SQL[name]).fetchall())
