"""Registered queries of the library and the SQL that checks them."""

from __future__ import annotations

import functools

from stratum.plans import check_queries, dialect, views


def _sql(spark, sf_dir, text):
    return views.run_sql(spark, sf_dir, text)


QUERIES: dict = {name: functools.partial(_sql, text=dialect.spark_text(name)) for name in dialect.DIALECT} | check_queries.QUERIES
ORACLE_SQL: dict[str, str] = {name: dialect.duck_text(name) for name in dialect.DIALECT} | check_queries.ORACLE_SQL
