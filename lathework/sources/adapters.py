"""Where an engine's tables come from: adapters by dialect or driver name.

An adapter has ``dialect``, ``driver`` and ``open(spark, **options) -> Engine``. The folder adapter reads
Parquet folders, the memory adapter starts empty, the JDBC adapter reads a database's tables through
Spark's own JDBC source (its driver must be on Spark's class path); writes go to the versioned store.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine, Options


class Adapter(Protocol):
    dialect: str
    driver: str

    def open(self, spark: SparkSession, **options: Any) -> Engine: ...


class FolderAdapter:
    dialect, driver = "spark", "parquet"

    def open(self, spark: SparkSession, folder: str | None = None, store: str | None = None, schema: str | None = None, defaults: Options | None = None, **_: Any) -> Engine:
        return Engine(spark, folder, store, schema, defaults)


class MemoryAdapter:
    """Tables from rows: ``tables={"name": (rows, schema)}``."""

    dialect, driver = "spark", "memory"

    def open(self, spark: SparkSession, tables: Mapping[str, tuple[list, Any]] | None = None, store: str | None = None, defaults: Options | None = None, **_: Any) -> Engine:
        out = Engine(spark, None, store, None, defaults)
        for name, (rows, schema) in (tables or {}).items():
            out.catalog.register(name, spark.createDataFrame(rows, schema))
        return out


class JdbcAdapter:
    """A database read through ``spark.read.format("jdbc")``; filters and columns are pushed down by Spark."""

    def __init__(self, dialect: str, driver: str):
        self.dialect, self.driver = dialect, driver

    def open(self, spark: SparkSession, url: str = "", properties: Mapping[str, str] | None = None, store: str | None = None, schema: str | None = None, defaults: Options | None = None, **_: Any) -> Engine:
        out = Engine(spark, None, store, schema, defaults)
        named = out.catalog.table

        def table(own: str | None, name: str) -> DataFrame:
            key = out.catalog._key(own, name)
            if key in out.catalog.named or out.catalog._current(key):
                return named(own, name)
            full = f"{own or schema}.{name}" if own or schema else name
            out.catalog.named[key] = spark.read.format("jdbc").options(url=url, dbtable=full, **(properties or {})).load()
            return out.catalog.named[key]

        out.catalog.table = table
        return out


_adapters: list[Adapter] = []


def register(adapter: Adapter) -> None:
    _adapters.append(adapter)


def unregister(adapter: Adapter) -> None:
    """Remove this adapter and no other."""
    if adapter in _adapters:
        _adapters.remove(adapter)


def find_dialect(dialect: str) -> Adapter | None:
    return next((a for a in _adapters if a.dialect == dialect), None)


def find_driver(driver: str) -> Adapter | None:
    return next((a for a in _adapters if a.driver == driver), None)


for _a in (FolderAdapter(), MemoryAdapter(), JdbcAdapter("postgres", "org.postgresql.Driver"), JdbcAdapter("oracle", "oracle.jdbc.OracleDriver"), JdbcAdapter("sqlite", "org.sqlite.JDBC"), JdbcAdapter("mssql", "com.microsoft.sqlserver.jdbc.SQLServerDriver")):
    register(_a)


def connect(spark: SparkSession, dialect: str | None = None, driver: str | None = None, **options: Any) -> Engine:
    """An engine from the adapter of a driver or dialect."""
    found = find_driver(driver) if driver else find_dialect(dialect or "spark")
    if found is None:
        raise ValueError(f"there is no adapter for {driver or dialect}")
    return found.open(spark, **options)
