"""Names every runnable query and, where SQL can say it, its oracle statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Opens the given parquet tables; Catalyst prunes columns and pushes filters."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(tables)`` under its own name; ``covers`` lists survey rows."""

    def register(fn):
        key = name or fn.__name__
        if key in _ENTRIES:
            raise ValueError(f"query {key} registered twice")
        _ENTRIES[key] = Entry(key, covers, fn, sql)
        return fn

    return register


def entries() -> dict[str, Entry]:
    import tidegauge.plans  # noqa: F401  (registers on import)

    return dict(_ENTRIES)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        return lambda spark, folder: entry.run(Tables(spark, folder))

    return {name: bind(entry) for name, entry in entries().items()}


def oracle_statements() -> dict[str, str]:
    return {name: e.sql for name, e in entries().items() if e.sql is not None}
