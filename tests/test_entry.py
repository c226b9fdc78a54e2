import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"block_id", "hit_rows"}


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100 and all(callable(q) for q in queries.values())
