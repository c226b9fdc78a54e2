"""Which base rows a query touches, from its analyzed plan: no key needs to be projected, no naming rule is followed."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from stratum.plans.lineage import _kind, _seq

#: Nodes above the joined rows of a query.
_ABOVE = ("Sort", "Project", "Aggregate", "GlobalLimit", "LocalLimit", "Distinct", "Window", "Offset")


def _has_aggregate(node) -> bool:
    """Whether a filter stands over a grouping (HAVING) rather than over rows."""
    while _kind(node) in ("Filter", "Project", "SubqueryAlias"):
        node = node.children().apply(0)
    return _kind(node) in ("Aggregate", "Window")


def _core(node):
    """The filtered and joined rows below the outputs, groupings and orders of a query."""
    while True:
        kind = _kind(node)
        if kind in _ABOVE or (kind == "Filter" and _has_aggregate(node.children().apply(0))):
            node = node.children().apply(0)
        else:
            return node


def _frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _instances(node) -> Iterator[tuple[str, dict[str, object]]]:
    """(table, attributes by name) of every instance of a table whose columns the node still gives."""
    if _kind(node) == "View":
        yield node.desc().identifier().table(), {a.name(): a for a in _seq(node.output())}
        return
    for child in _seq(node.children()):
        yield from _instances(child)


def star(spark: SparkSession, sql: str) -> DataFrame:
    """A query without its projection, grouping and order: all columns of the rows that its FROM and WHERE give."""
    return _frame(spark, _core(spark.sql(sql)._jdf.queryExecution().analyzed()))


def hits(spark: SparkSession, sql: str, keys: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Per table with known keys, the distinct keys of the rows that reach the joined rows of a query; the instances
    of a self-joined table are united. Tables whose columns do not reach them (in subqueries, say) are left out."""
    core = _core(spark.sql(sql)._jdf.queryExecution().analyzed())
    given = {a.exprId().id() for a in _seq(core.output())}
    found: dict[str, list[DataFrame]] = {}
    project = spark._jvm.org.apache.spark.sql.catalyst.plans.logical.Project
    for table, attributes in _instances(core):
        if table not in keys or any(k not in attributes or attributes[k].exprId().id() not in given for k in keys[table]):
            continue
        columns = spark._jvm.PythonUtils.toSeq([attributes[k] for k in keys[table]])
        found.setdefault(table, []).append(_frame(spark, project(columns, core)).toDF(*keys[table]))
    return {t: reduce(DataFrame.unionByName, parts).distinct() for t, parts in found.items()}
