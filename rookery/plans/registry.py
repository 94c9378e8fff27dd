"""All registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Domain, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a function of a Domain under `name`, with its twin. Whole numbers leave as longs, `dates` as text."""

    def put(function: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = function(Domain(spark, sf_dir))
            kinds = {"int": "bigint", "smallint": "bigint", "date": "string"}
            return out.withColumns({c: out[c].cast(kinds[k]) for c, k in out.dtypes if k in kinds})

        QUERIES[name] = run
        if sql:
            text = oracle(sql)
            if dates:
                text = "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates) + f") FROM ({text}) AS q"
            ORACLES[name] = text
        return function

    return put


def load() -> None:
    from . import queries_analytics, queries_characters, queries_corpus, queries_extras, queries_headings, queries_index, queries_intents, queries_lateral, queries_questions, queries_refine, queries_search, queries_sheets, queries_sources, queries_streaming, queries_tables, queries_text, queries_usage  # noqa: F401


load()
