"""Registered queries and their SQL oracles.

Each module of ``operators`` registers what it implements with ``query``; ``catalog`` loads
them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Registers a function of ``Tables``; ``oracle`` is SQL over the stored tables and ``views``."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle, *views, recursive=recursive)
        return f

    return add
