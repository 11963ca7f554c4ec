"""All registered queries with their SQL; the modules of this package register themselves here."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("retrieval", "texts", "relational", "signal_queries", "graph_queries", "dedup_queries", "web_queries", "store_queries", "stream_queries", "more", "scoring", "section_queries", "graph_rag_queries", "judgement_queries", "choice_queries", "summary_queries", "entity_queries", "ocr_queries", "frame_queries", "structured_queries", "routing_queries", "profile_queries")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the same query in DuckDB's SQL if there is one."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def oracle_text(f) -> str:
    """The SQL of a registered query, to build another on."""
    return _SQL[f.__name__]


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
