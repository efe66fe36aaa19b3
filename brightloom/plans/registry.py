"""The queries by name and their DuckDB SQL; modules beside this one add to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexemes_sql(col: str) -> str:
    """DuckDB's list of a text's words and, after them, of the pieces of its identifiers."""
    cut = "regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z])([0-9])', '\\1 \\2', 'g')"
    pieces = f"[trim(x) for x in regexp_extract_all({cut}, '[A-Z]?[a-z]+|[0-9]+|[A-Z]+(?: |$)')]"
    runs = f"[CASE WHEN len({pieces}) > 0 THEN array_to_string({pieces}, ' ') ELSE w END for w in regexp_extract_all(coalesce({col}, ''), '[\\p{{L}}\\p{{N}}]+')]"
    return f"regexp_extract_all(lower(coalesce({col}, '')) || ' ' || replace(lower(array_to_string({runs}, ' ')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


def covers_sql(source: str, key: str, lexemes: str, tokens: list[str]) -> str:
    """(key, score): the cover density of all tokens in a column of lexemes, 0.1 for each least cover over 1 and the other words inside; only keys that have one."""
    last = ", ".join(f"max(CASE WHEN t = '{x}' THEN i END) OVER w AS p{n}" for n, x in enumerate(tokens))
    every = " AND ".join(f"p{n} IS NOT NULL" for n in range(len(tokens)))
    low = f"CASE WHEN {every} THEN least({', '.join(f'p{n}' for n in range(len(tokens)))}) END"
    return f"""SELECT {key}, sum(0.1::DOUBLE / (1 + i - lo + 1 - {len(tokens)})) AS score FROM (SELECT *, lag(lo) OVER (PARTITION BY {key} ORDER BY i) AS before FROM (
        SELECT {key}, i, {low} AS lo FROM (SELECT {key}, i, {last} FROM (SELECT {key}, unnest({lexemes}) AS t, generate_subscripts({lexemes}, 1) AS i FROM {source})
            WHERE t IN ({', '.join(f"'{x}'" for x in tokens)}) WINDOW w AS (PARTITION BY {key} ORDER BY i)))) WHERE lo IS NOT NULL AND (before IS NULL OR lo > before) GROUP BY {key}"""
