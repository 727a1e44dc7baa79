"""Running queries: options, events, results, writes and transactions."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import FieldInfo, FieldMap, Naming, named_fields, shaped_rows
from ..operators import elements, queries
from ..operators.base import Node
from ..operators.types import DataType, from_spark
from ..plans import Compiler, Scope
from ..plans.compiler import OuterRaw, has_raw, tables_of, with_tables
from ..streaming.cursor import Cursor
from .catalog import Catalog


class EngineError(RuntimeError):
    """A failed query, with what was asked; the cause is chained."""

    def __init__(self, message: str, query: Any = None, options: Options | None = None):
        super().__init__(message)
        self.query, self.options = query, options


@dataclass(frozen=True)
class Options:
    """How a query is run. None falls back to the engine's defaults, then to the value in brackets."""

    auto_commit: bool | None = None  # (True)
    cursor: bool | None = None  # (False)
    object_rows: bool | None = None  # (True): dicts, else lists
    naming: Naming = None  # (as they are)
    ignore_nulls: bool | None = None  # (False): only for dicts
    fetch_rows: int | None = None  # (100): most rows that execute() gathers; 0 for all
    fetch_as_string: tuple[DataType, ...] | None = None
    transform: Callable[[Any, FieldInfo], Any] | None = None
    show_sql: bool | None = None
    pretty_print: bool | None = None  # (False): how show_sql lays the text out
    action: str | None = None

    def over(self, defaults: Options) -> Options:
        return replace(self, **{f.name: getattr(defaults, f.name) for f in fields(self) if getattr(self, f.name) is None})


@dataclass
class Result:
    rows: list[Any] = field(default_factory=list)
    fields: FieldMap | None = None
    rows_affected: int = 0
    row_type: str = "object"
    cursor: Cursor | None = None
    execute_time: float = 0.0
    sql: str | None = None


FALLBACK = Options(auto_commit=True, cursor=False, object_rows=True, ignore_nulls=False, fetch_rows=100, show_sql=False, pretty_print=False)


class Engine:
    """One Spark session with a catalog: compiles, runs and reads back queries."""

    def __init__(self, spark: SparkSession, folder: str | None = None, store: str | None = None, schema: str | None = None, defaults: Options | None = None):
        self.spark = spark
        self.catalog = Catalog(spark, folder, store, schema)
        self.defaults = (defaults or Options()).over(FALLBACK)
        self.listeners: dict[str, list[Callable]] = {}
        self.closed = False
        self._users = 1

    @classmethod
    def from_env(cls, spark: SparkSession, prefix: str = "DB_", env: Mapping[str, str] | None = None) -> Engine:
        """An engine set up by ``<prefix>FOLDER``, ``STORE``, ``SCHEMA`` and ``FETCH_ROWS``; tests itself unless ``LAZY_CONNECT``."""
        env = os.environ if env is None else env
        rows = env.get(f"{prefix}FETCH_ROWS")
        out = cls(spark, env.get(f"{prefix}FOLDER"), env.get(f"{prefix}STORE"), env.get(f"{prefix}SCHEMA"), Options(fetch_rows=int(rows)) if rows else None)
        if env.get(f"{prefix}LAZY_CONNECT", "").lower() not in ("1", "true", "yes"):
            out.test()
        return out

    # -- events and lifetime

    def on(self, event: str, listener: Callable) -> Engine:
        """Listen to execute, error, start-transaction, commit, rollback, savepoint events, retain, release or close."""
        self.listeners.setdefault(event, []).append(listener)
        return self

    def emit(self, event: str, *args: Any) -> None:
        for listener in list(self.listeners.get(event, ())):
            listener(*args)

    def test(self) -> None:
        self.spark.range(1).count()

    def retain(self) -> None:
        self._users += 1
        self.emit("retain", self._users)

    def release(self) -> None:
        self._users -= 1
        self.emit("release", self._users)
        if self._users <= 0:
            self.close()

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            if self.catalog.in_transaction:
                self.catalog.rollback()
            self.emit("close")

    def get_schema(self) -> str | None:
        return self.catalog.schema

    def set_schema(self, schema: str | None) -> None:
        self.catalog.schema = schema

    # -- transactions

    def start_transaction(self) -> None:
        self.catalog.begin()
        self.emit("start-transaction")

    def commit(self) -> None:
        self.catalog.commit()
        self.emit("commit")

    def rollback(self) -> None:
        self.catalog.rollback()
        self.emit("rollback")

    def set_savepoint(self, name: str) -> None:
        """Starts a transaction where there is none."""
        self.catalog.savepoint(name)
        self.emit("set-savepoint", name)

    def release_savepoint(self, name: str) -> None:
        self.catalog.release(name)
        self.emit("release-savepoint", name)

    def rollback_to_savepoint(self, name: str) -> None:
        self.catalog.rollback_to(name)
        self.emit("rollback-savepoint", name)

    # -- queries

    def compiler(self, params: Mapping[str, Any] | None = None) -> Compiler:
        return Compiler(self.spark, self.catalog.table, params, self.catalog.counter, self.catalog.staged)

    def dataframe(self, query: Node | str, params: Mapping[str, Any] | None = None) -> DataFrame:
        """The query's rows, not yet computed and without any cap."""
        if isinstance(query, str):
            return self.spark.sql(query, args=dict(params or {}))
        try:
            return self.compiler(params).query(query)
        except (AnalysisException, OuterRaw) as e:
            if isinstance(e, AnalysisException) and not (isinstance(query, queries.Query) and has_raw(query)):
                raise
            return self._by_text(query, params)

    def _by_text(self, query: queries.Query, params: Mapping[str, Any] | None) -> DataFrame:
        """Through SQL text: raw text in a sub-query may name tables of the query around it, which only the parser resolves.

        The query's tables become temporary views for as long as it is analysed; their names are made up, so
        none of the user's is replaced.
        """
        mark = uuid.uuid4().hex[:12]
        views = {name: f"lathework_{mark}_{i}" for i, name in enumerate(sorted(tables_of(query)))}
        for name, view in views.items():
            self.catalog.table(None, name).createOrReplaceTempView(view)
        try:
            made = with_tables(query, views).generate("spark", params)
            return self.spark.sql(made.sql, args=made.params)
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    def execute(self, query: Node | str, params: Mapping[str, Any] | None = None, **options: Any) -> Result:
        """Run a query; its rows are gathered up to ``fetch_rows`` (100 unless set; 0 for all)."""
        if self.closed:
            raise EngineError("the engine is closed", query)
        own = Options(**options).over(self.defaults)
        began = time.perf_counter()
        try:
            if isinstance(query, queries.Query) and query.comments:
                self.spark.sparkContext.setJobDescription("\n".join(t for t, d in query.comments if not d or "spark" in d))
            if own.action:
                self.spark.sparkContext.setJobDescription(own.action)
            request = {"query": query, "params": dict(params or {}), "options": own}
            if isinstance(query, queries.Query):
                for hook in query.listeners.get("execute", ()):
                    hook(request)
            self.emit("execute", request)
            params = request["params"]
            if isinstance(query, (queries.Insert, queries.Update, queries.Delete)):
                if not own.auto_commit and not self.catalog.in_transaction:
                    self.start_transaction()
                out = self._write(query, params, own)
            else:
                out = self._read(query, params, own)
            if own.show_sql and isinstance(query, queries.Query):
                out.sql = query.generate("spark", params, pretty=bool(own.pretty_print)).sql
            out.execute_time = time.perf_counter() - began
            return out
        except EngineError:
            raise
        except Exception as e:
            self.emit("error", e)
            raise EngineError(str(e).split("\n")[0], query, own) from e

    def _as_strings(self, df: DataFrame, kinds: tuple[DataType, ...] | None) -> DataFrame:
        wanted = [f.name for f in df.schema.fields if kinds and from_spark(f.dataType)[0] in kinds]
        return df.withColumns({n: F.col(f"`{n}`").cast("string") for n in wanted}) if wanted else df

    def _read(self, query: Node | str, params: Mapping[str, Any], own: Options) -> Result:
        df = self._as_strings(self.dataframe(query, params), own.fetch_as_string)
        info = named_fields(df.schema, own.naming)
        hooks = list(query.listeners.get("fetch", ())) if isinstance(query, queries.Query) else []

        def shape(rows: list[Row]) -> list[Any]:
            out = shaped_rows(rows, info, own.object_rows, own.ignore_nulls, own.transform)
            for row in out:
                for hook in list(query.listeners.get("fetch", ())) if hooks else ():
                    hook(row, info)
            return out

        kind = "object" if own.object_rows else "array"
        if own.cursor:
            self.retain()
            cursor = Cursor(df, info, shape, own.fetch_rows or 100, self.release)
            self.on("close", cursor.close)
            return Result(fields=info, row_type=kind, cursor=cursor)
        rows = (df.limit(own.fetch_rows) if own.fetch_rows else df).collect()
        return Result(shape(rows), info, row_type=kind)

    # -- writes

    def _write(self, query: Any, params: Mapping[str, Any], own: Options) -> Result:
        if not isinstance(query.table, elements.Table):
            raise EngineError("writes need a named table", query)
        compiler = self.compiler({**query.params, **params})
        if isinstance(query, queries.Insert):
            count, back = self._insert(query, compiler)
        else:
            count, back = self._change(query, compiler)
        if back is None:
            return Result(rows_affected=count)
        info = named_fields(back.schema, own.naming)
        back = back.limit(own.fetch_rows) if own.fetch_rows else back
        return Result(shaped_rows(back.collect(), info, own.object_rows, own.ignore_nulls, own.transform), info, count)

    def _returned(self, query: Any, df: DataFrame) -> DataFrame | None:
        return df.select(*[F.col(f"`{c.name}`").alias(c.alias or c.name) for c in query.returned]) if query.returned else None

    def _insert(self, query: queries.Insert, compiler: Compiler) -> tuple[int, DataFrame | None]:
        t = query.table
        if isinstance(query.source, Mapping):
            values = {k: compiler.expression(v, Scope()) for k, v in query.source.items()}
            rows = self.spark.range(1).select(*[v.alias(k) for k, v in values.items()])
        else:
            rows = compiler.query(query.source)
        count, written = self.catalog.append(t.schema, t.name, rows)
        return count, self._returned(query, written)

    def _change(self, query: queries.Update | queries.Delete, compiler: Compiler) -> tuple[int, DataFrame | None]:
        t = query.table
        alias = t.alias or t.name
        scope = Scope()
        _, manifest = self.catalog.manifest(t.schema, t.name)
        scope.add(alias, self.catalog.read(manifest))
        where = compiler.condition(query.condition, scope) if query.condition else None
        where = F.lit(True) if where is None else where
        if isinstance(query, queries.Delete):
            return self.catalog.rewrite(t.schema, t.name, alias, where, None)[0], None
        known = {f.name.lower(): f for f in manifest.schema.fields}
        for k in query.changes:
            if k.lower() not in known:
                raise ValueError(f"{t.name} has no column {k}")
        new = {known[k.lower()].name: compiler.expression(v, scope).cast(known[k.lower()].dataType) for k, v in query.changes.items()}
        sure = F.coalesce(where, F.lit(False))

        def change(df: DataFrame) -> DataFrame:
            return df.select(*[F.when(sure, new[f.name]).otherwise(F.col(f"`{alias}`.`{f.name}`")).alias(f.name) if f.name in new else F.col(f"`{alias}`.`{f.name}`") for f in manifest.schema.fields])

        count, before = self.catalog.rewrite(t.schema, t.name, alias, where, change)
        return count, self._returned(query, change(before)) if query.returned else None
