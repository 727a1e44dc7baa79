"""Running a package's migrations, with their state in two tables of the engine's catalog."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import types as T

from ..operators import Insert, Select, Update
from ..sources import Engine
from .package import FunctionTask, InsertTask, Migration, Package, SqlTask, Task

_SUMMARY = T.StructType(
    [
        T.StructField("package_name", T.StringType()), T.StructField("status", T.StringType()), T.StructField("current_version", T.IntegerType()),
        T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType()),
    ]
)
_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("package_name", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("event", T.StringType()),
        T.StructField("event_time", T.TimestampNTZType()), T.StructField("title", T.StringType()), T.StructField("message", T.StringType()), T.StructField("filename", T.StringType()),
        T.StructField("details", T.StringType()),
    ]
)


class MigrationError(RuntimeError):
    pass


def substitute(text: str, variables: dict[str, Any]) -> str:
    """``$(name)`` by its value; unknown names stay."""
    return re.sub(r"\$\((\w+)\)", lambda m: str(variables.get(m[1], m[0])), text)


def statements(script: str) -> list[str]:
    """The script cut at semicolons outside quotes and comments."""
    out, now, quote, i = [], "", "", 0
    while i < len(script):
        c = script[i]
        if quote:
            now += c
            quote = "" if c == quote else quote
        elif script.startswith("--", i):
            i = script.find("\n", i)
            if i < 0:
                break
            now += "\n"
        elif script.startswith("/*", i):
            i = script.find("*/", i) + 1
            if i < 1:
                break
        elif c == ";":
            out.append(now.strip())
            now = ""
        else:
            quote = c if c in "'\"`" else ""
            now += c
        i += 1
    return [s for s in [*out, now.strip()] if s]


class Migrator:
    def __init__(self, engine: Engine, package: Package, variables: dict[str, Any] | None = None, summary: str = "migration_summary", events: str = "migration_events"):
        self.engine, self.package, self.variables = engine, package, {"schema": engine.get_schema() or "default", **(variables or {})}
        self.summary, self.events = summary, events
        self.listeners: dict[str, list[Callable]] = {}

    def on(self, event: str, listener: Callable) -> Migrator:
        """Listen to start, backup, migration-start, task-start, task-finish, migration-finish, restore or finish."""
        self.listeners.setdefault(event, []).append(listener)
        return self

    def _emit(self, event: str, **about: Any) -> None:
        for listener in self.listeners.get(event, ()):
            listener(about)

    # -- state

    def _prepare(self) -> None:
        catalog = self.engine.catalog
        for name, schema in ((self.summary, _SUMMARY), (self.events, _EVENTS)):
            if name not in catalog.committed and not catalog.load(name):
                catalog.create(name, schema)
        if not self.engine.execute(Select().from_(self.summary).where({"package_name": self.package.name})).rows:
            self.engine.execute(Insert(self.summary, {"package_name": self.package.name, "status": "idle", "current_version": 0, "created_at": dt.datetime.now()}))

    @property
    def version(self) -> int:
        self._prepare()
        return self.engine.execute(Select("current_version v").from_(self.summary).where({"package_name": self.package.name})).rows[0]["v"]

    def _set(self, **values: Any) -> None:
        self.engine.execute(Update(self.summary, {**values, "updated_at": dt.datetime.now()}).where({"package_name": self.package.name}))

    def _write_event(self, event: str, migration: Migration, task: Task, message: str, details: str | None = None) -> None:
        number = self.engine.catalog.counter(f"{self.events}.id")
        row = {
            "id": number, "package_name": self.package.name, "version": migration.version, "event": event, "event_time": dt.datetime.now(), "title": task.title, "message": message,
            "filename": task.filename, "details": details,
        }
        self.engine.execute(Insert(self.events, row))

    # -- running

    def execute(self, target_version: int | None = None) -> bool:
        """Run what is newer than the current version, up to the target. Stops at the first error and restores what a backup holds."""
        versions = [m.version for m in self.package.migrations]
        low, high = min(versions, default=0), max(versions, default=0)
        target = min(target_version or high, high)
        if target and target < low:
            raise MigrationError(f"the target version {target} is lower than the package's lowest, {low}")
        current = self.version
        if current and current < low - 1:
            raise MigrationError(f"the package can start from {low - 1}, but the version is {current}")
        total = sum(len(m.tasks) for m in self.package.migrations)
        backup = any(m.backup for m in self.package.migrations)
        self._emit("start")
        saved = None
        if backup:
            self._emit("backup")
            saved = dict(self.engine.catalog.committed)
        try:
            for index, migration in enumerate(self.package.migrations):
                if migration.version > target or current >= migration.version:
                    continue
                self._emit("migration-start", migration=migration, total=len(self.package.migrations), index=index)
                for i, task in enumerate(migration.tasks):
                    self._emit("task-start", migration=migration, task=task, total=total, index=i)
                    self._set(status="busy")
                    self._write_event("started", migration, task, f'Task "{task.title}" started')
                    try:
                        self._run(migration, task)
                    except Exception as e:
                        self._write_event("error", migration, task, str(e).split("\n")[0], repr(e))
                        raise MigrationError(f"task {task.title} of version {migration.version} failed: {e}") from e
                    self._write_event("success", migration, task, f'Task "{task.title}" completed')
                    self._emit("task-finish", migration=migration, task=task, total=total, index=i)
                self._set(current_version=migration.version, status="idle")
                self._emit("migration-finish", migration=migration, total=len(self.package.migrations), index=index)
        except MigrationError:
            if saved is not None:
                self._emit("restore")
                state = {k: self.engine.catalog.committed[k] for k in (self.summary, self.events)}
                self.engine.catalog.committed = saved | state
            raise
        self._emit("finish")
        return True

    def _run(self, migration: Migration, task: Task) -> None:
        if isinstance(task, SqlTask):
            script = task.script(self.variables) if callable(task.script) else task.script
            for statement in statements(substitute(script, self.variables)):
                self.engine.spark.sql(statement)
        elif isinstance(task, InsertTask):
            table = substitute(task.table, self.variables)
            if table in self.engine.catalog.committed or table in self.engine.catalog.named:
                schema = self.engine.catalog.table(None, table).schema
                names = {f.name.lower(): f for f in schema.fields}
                keys = {k.lower() for r in task.rows for k in r}
                kept = T.StructType([f for n, f in names.items() if n in keys])
                rows = [tuple({k.lower(): v for k, v in r.items()}.get(f.name.lower()) for f in kept.fields) for r in task.rows]
                self.engine.catalog.append(None, table, self.engine.spark.createDataFrame(rows, kept))
            else:
                self._into_spark(table, task.rows)
        elif isinstance(task, FunctionTask):
            task.fn(self.engine, self)

    def _into_spark(self, table: str, rows: list[dict[str, Any]]) -> None:
        """Append to a table of Spark's own catalog, column by column."""
        schema = self.engine.spark.table(table).schema
        whole = [tuple({k.lower(): v for k, v in r.items()}.get(f.name.lower()) for f in schema.fields) for r in rows]
        self.engine.spark.createDataFrame(whole, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])).write.insertInto(table)


def migrate(engine: Engine, package: Package, target_version: int | None = None, **options: Any) -> bool:
    return Migrator(engine, package, **options).execute(target_version)

