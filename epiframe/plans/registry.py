"""All queries by name, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a (spark, sf_dir) function under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


from epiframe.plans import control_queries, data_queries, report_queries, signal_queries, table_queries  # noqa: E402, F401
