"""Loading versioned migrations from objects, functions and files."""

from __future__ import annotations

import glob
import importlib.util
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class SqlTask:
    """Statements, as text or as a function of the variables."""

    script: str | Callable[[dict[str, Any]], str]
    title: str | None = None
    filename: str | None = None


@dataclass
class InsertTask:
    table: str
    rows: list[dict[str, Any]]
    title: str | None = None
    filename: str | None = None


@dataclass
class FunctionTask:
    fn: Callable[..., Any]
    title: str | None = None
    filename: str | None = None


Task = SqlTask | InsertTask | FunctionTask


@dataclass
class Migration:
    version: int
    tasks: list[Task]
    base_dir: str = "."
    backup: bool = False


@dataclass
class Package:
    name: str
    migrations: list[Migration] = field(default_factory=list)
    base_dir: str = "."
    schema: str = "migrations"


def as_task(x: Any) -> Task:
    if isinstance(x, (SqlTask, InsertTask, FunctionTask)):
        return x
    if not isinstance(x, dict):
        raise TypeError(f"{x!r} is no migration task")
    names = {"title": x.get("title"), "filename": x.get("filename")}
    if isinstance(x.get("script"), str) or callable(x.get("script")):
        return SqlTask(x["script"], **names)
    table = x.get("tableName", x.get("table"))
    if isinstance(table, str) and isinstance(x.get("rows"), list):
        return InsertTask(table, x["rows"], **names)
    if callable(x.get("fn")):
        return FunctionTask(x["fn"], **names)
    raise TypeError(f"{sorted(x)} make no migration task")


def _python(path: str) -> Any:
    spec = importlib.util.spec_from_file_location("migration_" + os.path.basename(path).replace(".", "_"), path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    for name in ("migration", "task"):
        if hasattr(module, name):
            found = getattr(module, name)
            return found() if callable(found) and not isinstance(found, type) else found
    raise TypeError(f"{path} defines neither migration nor task")


def _task_files(pattern: str, base: str) -> list[Task]:
    out: list[Task] = []
    for path in sorted(glob.glob(os.path.join(base, pattern), recursive=True)):
        name = os.path.basename(path)
        if name.endswith(".task.sql"):
            with open(path, encoding="utf-8") as f:
                out.append(SqlTask(f.read(), name.removesuffix(".task.sql"), path))
        elif name.endswith(".task.json"):
            with open(path, encoding="utf-8") as f:
                task = as_task(json.load(f))
        elif name.endswith(".task.py"):
            task = as_task(_python(path))
        else:
            continue
        if not name.endswith(".task.sql"):
            task.filename, task.title = path, task.title or name.rsplit(".task.", 1)[0]
            out.append(task)
    return out


def _migration(x: Any, base: str) -> Migration:
    if callable(x):
        x = x()
    if isinstance(x, Migration):
        return x
    tasks: list[Task] = []
    base = x.get("baseDir", base)
    for t in x.get("tasks", []):
        if isinstance(t, str):
            tasks += _task_files(t, base)
        else:
            tasks.append(as_task(t() if callable(t) and not isinstance(t, (SqlTask, InsertTask, FunctionTask)) else t))
    return Migration(int(x["version"]), tasks, base, bool(x.get("backup")))


def load(name: str, migrations: Any, base_dir: str = ".", schema: str = "migrations") -> Package:
    """A package of migrations in order of version: dicts, Migrations, functions, or globs of ``migration.json`` / ``migration.py``."""
    if not isinstance(migrations, (list, tuple)):
        raise TypeError("migrations must be a list")
    out: list[Migration] = []
    for m in migrations:
        if isinstance(m, str):
            for path in sorted(glob.glob(os.path.join(base_dir, m), recursive=True)):
                if os.path.basename(path) in ("migration.json", "migration.py"):
                    with open(path, encoding="utf-8") as f:
                        own = json.load(f) if path.endswith(".json") else _python(path)
                    out.append(_migration(own, os.path.dirname(path)))
        else:
            out.append(_migration(m, base_dir))
    return Package(name, sorted(out, key=lambda m: m.version), base_dir, schema)
