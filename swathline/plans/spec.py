"""Registry of queries: what Spark runs, and the SQL that DuckDB runs to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Tables, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Column = str | tuple[str, int]


def _expr(c: Column) -> str:
    """A column's SQL; with decimals it is rounded, and never minus zero."""
    return c if isinstance(c, str) else f"round({c[0]}, {c[1]}) + 0e0"


def projection(name: str, view: str, columns: dict[str, Column], where: str | None = None) -> None:
    """A query that projects (and filters) one view."""
    exprs = [f"{_expr(c)} AS {k}" for k, c in columns.items()]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Tables(spark, sf_dir)[view]
        return (df.where(where) if where else df).selectExpr(*exprs)

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {', '.join(exprs)} FROM {duckdb_sql('{' + view + '}')}" + (f" WHERE {where}" if where else "")


def operator(name: str, oracle: str | None = None, rounded: dict[str, int] | None = None) -> Callable:
    """Registers a function of ``Tables`` that builds a DataFrame; ``oracle`` may hold ``{view}`` marks.

    ``rounded``: decimals of columns, applied on both sides.
    """

    def over(columns: list[str]) -> list[str]:
        return [_expr((c, rounded[c])) + f" AS {c}" if rounded and c in rounded else c for c in columns]

    def add(build: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Tables(spark, sf_dir))
            return df.selectExpr(*over(df.columns)) if rounded else df

        QUERIES[name] = run
        if oracle:
            text = duckdb_sql(oracle)
            replace = ", ".join(f"{_expr((c, d))} AS {c}" for c, d in (rounded or {}).items())
            ORACLE[name] = f"SELECT * REPLACE ({replace}) FROM ({text})" if rounded else text
        return build

    return add


def statement(name: str, text: str, rounded: dict[str, int] | None = None) -> None:
    """A query whose clearest form is one SQL statement over views, the same for both engines."""
    operator(name, text, rounded)(lambda t: t.sql(text))
