"""Migrations."""

import json

import pytest
from pyspark.sql import types as T

from lathework.migrate import MigrationError, Migrator, load, statements, substitute
from lathework.operators import Select
from lathework.sources import Engine


def test_text_helpers():
    assert substitute("a $(x) $(y)", {"x": 1}) == "a 1 $(y)"
    assert statements("a; -- b;\n c ';' ; /* d; */ e") == ["a", "c ';'", "e"]


@pytest.fixture()
def fresh(spark, tmp_path):
    return Engine(spark, store="file://" + str(tmp_path / "store"))


def test_runs_in_order_and_skips(fresh, tmp_path):
    (tmp_path / "v3").mkdir()
    (tmp_path / "v3" / "migration.json").write_text(json.dumps({"version": 3, "tasks": ["*.task.json"]}))
    (tmp_path / "v3" / "rows.task.json").write_text(json.dumps({"tableName": "t", "rows": [{"id": 3, "name": "c"}]}))
    seen = []
    make = lambda engine, migrator: engine.catalog.create("t", T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))
    package = load("p", ["*/migration.json", lambda: {"version": 2, "tasks": [{"table": "t", "rows": [{"id": 2}], "title": "two"}]}, {"version": 1, "tasks": [{"fn": make, "title": "make"}, {"script": "create or replace temp view v as select '$(word)' as w"}]}], str(tmp_path))
    assert [m.version for m in package.migrations] == [1, 2, 3]
    m = Migrator(fresh, package, {"word": "hello"})
    for e in ("start", "task-finish", "migration-finish", "finish"):
        m.on(e, lambda about, e=e: seen.append(e))
    assert m.execute(2) and m.version == 2
    assert m.execute() and m.version == 3
    assert seen == ["start", "task-finish", "task-finish", "migration-finish", "task-finish", "migration-finish", "finish", "start", "task-finish", "migration-finish", "finish"]
    assert sorted(r["id"] for r in fresh.execute(Select().from_("t")).rows) == [2, 3]
    assert fresh.spark.table("v").first()[0] == "hello"
    events = fresh.execute(Select("event").from_("migration_events")).rows
    assert sum(e["event"] == "success" for e in events) == 4


def test_errors_stop_and_restore(fresh):
    make = lambda engine, migrator: engine.catalog.create("t", T.StructType([T.StructField("id", T.IntegerType())]))
    package = load("p", [{"version": 5, "backup": True, "tasks": [{"fn": make}, {"script": "select * from nowhere_at_all"}]}])
    seen = []
    m = Migrator(fresh, package).on("restore", lambda about: seen.append("restore"))
    with pytest.raises(MigrationError):
        m.execute()
    assert seen == ["restore"] and "t" not in fresh.catalog.committed and m.version == 0
    with pytest.raises(MigrationError, match="lower"):
        m.execute(4)
    with pytest.raises(TypeError):
        load("p", [{"version": 1, "tasks": [{"odd": 1}]}])
