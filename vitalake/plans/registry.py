"""Registered queries: name, covered operator ids, Spark callable, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Runner
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``ids`` are blueprint row ids."""

    def add(fn: Runner) -> Runner:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, tuple(ids.split()), fn, sql)
        return fn

    return add
