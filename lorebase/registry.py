"""Queries of the library's own operators with their SQL, filed by the modules of ``plans``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

FLAGSHIP = "ret_05_search_with_context"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Files a function of Tables under a name, with the SQL that gives the same rows, if SQL can."""

    def wrap(f: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is there already")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        _QUERIES[name] = run
        if sql:
            _ORACLES[name] = sql
        return f

    return wrap


def _load() -> None:
    from .plans import catalog, evaluation, ingest, relational, retrieval, scalars, streams, text_tools, vectors, versions  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracles() -> dict:
    _load()
    return dict(_ORACLES)
