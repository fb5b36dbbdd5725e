"""Queries by the id of their operator: a function of Tables, and the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.bindings import Tables, inlined
from quern.session import importable

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(fn: Callable[[Tables], DataFrame]) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = (fn, sql)
        return fn

    return put


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, fn=fn: fn(Tables(importable(spark), folder))) for name, (fn, _) in QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: inlined(sql) for name, (_, sql) in QUERIES.items() if sql}


#: The nodes of the link graph, for SQL.
NODES = "(SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges})"


def rank_sql(rounds: int = 10) -> str:
    """SQL of PageRank: tables r0 to the last round's."""
    steps = [f"ed AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM {{edges}}), nodes AS MATERIALIZED (SELECT node FROM {NODES}), r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    steps += [f"r{i} AS MATERIALIZED (SELECT n.node, (1 - 0.85::DOUBLE) / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * coalesce(g.given, 0) AS rank FROM nodes n LEFT JOIN (SELECT dst, sum(rank / degree) AS given FROM ed JOIN r{i - 1} ON node = src GROUP BY dst) g ON g.dst = n.node)" for i in range(1, rounds + 1)]
    return "WITH " + ", ".join(steps)


#: Dictionary words near the terms of a table called misspelled, for SQL.
SPELL = """(SELECT m.term, d.word, levenshtein(m.term, d.word) AS distance FROM {misspelled} m JOIN {dictionary} d
    ON length(d.word) BETWEEN length(m.term) - 1 AND length(m.term) + 1 AND substr(d.word, 1, CASE WHEN length(m.term) > 3 THEN length(m.term) - 2 ELSE 1 END) = substr(m.term, 1, CASE WHEN length(m.term) > 3 THEN length(m.term) - 2 ELSE 1 END)
    WHERE levenshtein(m.term, d.word) <= CASE WHEN length(m.term) <= 4 THEN 1 ELSE least(2, length(m.term) // 4) END)"""
