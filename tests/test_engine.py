"""Results, cursors, writes and transactions."""

import pytest

from lathework.functions import rename
from lathework.operators import *
from lathework.sources import Catalog, Engine, EngineError
from lathework.operators.types import DataType


def test_naming():
    for name in ("HELLO_WORLD", "hello_world", "Hello_World"):
        assert rename(name, "CamelCase") == "helloWorld" and rename(name, "pascalcase") == "HelloWorld"
    assert rename("Ab", "uppercase") == "AB" and rename("Ab", "lowercase") == "ab" and rename("x", lambda n: None) is None


def test_rows_shapes_and_options(engine):
    q = Select("r_regionkey", "r_name").from_("region").order_by("r_regionkey")
    assert len(engine.execute(Select().from_("customer")).rows) == 100
    assert len(engine.execute(Select().from_("customer"), fetch_rows=0).rows) > 100
    assert engine.execute(q, object_rows=False).rows[0] == [0, "AFRICA"]
    assert engine.execute(q, naming="uppercase").rows[0] == {"R_REGIONKEY": 0, "R_NAME": "AFRICA"}
    assert engine.execute(q, naming=lambda n: n if n == "r_name" else None).rows[0] == {"r_name": "AFRICA"}
    nulls = Select(Raw("cast(null as int) as a"), Raw("1 as b"))
    assert engine.execute(nulls, ignore_nulls=True).rows == [{"b": 1}]
    assert engine.execute(nulls, ignore_nulls=True, transform=lambda v, f: 7 if v is None else v).rows == [{"a": 7, "b": 1}]
    seen = []
    engine.execute(Select("r_name").from_("region").on_fetch(lambda row, info: seen.append(row["r_name"])))
    assert len(seen) == 5
    r = engine.execute(Select("o_orderdate").from_("orders").limit(1), fetch_as_string=(DataType.TIMESTAMP,))
    assert isinstance(r.rows[0]["o_orderdate"], str) and r.fields.get("O_ORDERDATE").name == "o_orderdate"


def test_errors_are_wrapped(engine):
    seen = []
    engine.on("error", seen.append)
    with pytest.raises(EngineError) as e:
        engine.execute(Select("nothing").from_("region"))
    assert e.value.__cause__ is seen[0] and e.value.query is not None


def test_cursor(engine):
    q = Select("r_name").from_("region").order_by("r_name")
    c = engine.execute(q, cursor=True, fetch_rows=2).cursor.cached()
    assert c.is_bof and c.next()["r_name"] == "AFRICA" and c.row_num == 1
    assert c.seek(2)["r_name"] == "ASIA" and c.prev()["r_name"] == "AMERICA" and c.seek(0)["r_name"] == "AMERICA"
    assert c.seek(100) is None and c.row_num == 6 and c.is_eof and c.fetched_rows == 5
    c.reset()
    assert len(c.fetch_all()) == 5
    plain = engine.execute(q, cursor=True).cursor
    plain.next()
    with pytest.raises(RuntimeError):
        plain.prev()
    with pytest.raises(RuntimeError):
        plain.reset()
    with pytest.raises(RuntimeError):
        plain.cached()
    assert [r["r_name"] for r in engine.execute(q, cursor=True).cursor.to_stream(True, 2)] == ["AFRICA", "AMERICA"]
    text = "".join(engine.execute(q, cursor=True).cursor.to_stream())
    assert text.startswith('[{"r_name": "AFRICA"},') and text.endswith("]")


def test_writes_touch_only_affected_files(engine):
    before = engine.catalog.manifest(None, "nation")[1]
    engine.execute(Insert("nation", {"n_nationkey": 50, "n_name": "new"}))
    now = engine.catalog.manifest(None, "nation")[1]
    assert set(before.files) < set(now.files)
    assert engine.execute(Update("nation", {"n_name": "newer"}).where({"n_nationkey": 50})).rows_affected == 1
    last = engine.catalog.manifest(None, "nation")[1]
    assert set(before.files) < set(last.files)
    assert engine.execute(Delete("nation").where({"n_nationkey": 1000})).rows_affected == 0
    with pytest.raises(EngineError):
        engine.execute(Insert("nation", {"no_column": 1}))


def test_transactions_and_saved_manifests(spark, engine):
    count = lambda e: e.execute(Select(Count().as_("n")).from_("region")).rows[0]["n"]
    events = []
    for name in ("start-transaction", "commit", "rollback"):
        engine.on(name, lambda name=name: events.append(name))
    engine.start_transaction()
    engine.execute(Delete("region").where({"r_regionkey": 1}))
    assert count(engine) == 4
    engine.rollback()
    assert count(engine) == 5
    engine.set_savepoint("a")
    engine.execute(Delete("region"))
    engine.rollback_to_savepoint("a")
    engine.execute(Delete("region").where({"r_regionkey <": 2}))
    engine.release_savepoint("a")
    engine.commit()
    assert count(engine) == 3 and events == ["start-transaction", "rollback", "commit"]
    engine.execute(Delete("nation"), auto_commit=False)
    assert engine.catalog.in_transaction
    engine.rollback()
    other = Catalog(spark, store=engine.catalog.store)
    assert other.load("region") and other.table(None, "region").count() == 3
    with pytest.raises(ValueError):
        engine.rollback_to_savepoint("b")


def test_sequences_and_from_env(spark, engine):
    assert engine.execute(Select(Sequence("s").next().as_("a"), Sequence("s").as_("b"))).rows == [{"a": 1, "b": 1}]
    e = Engine.from_env(spark, "X_", {"X_FOLDER": "/nowhere", "X_FETCH_ROWS": "7"})
    assert e.catalog.folder == "/nowhere" and e.defaults.fetch_rows == 7


def test_adapters(spark):
    from lathework import sources

    e = sources.connect(spark, driver="memory", tables={"t": ([(1, "a"), (2, None)], "k int, v string")})
    assert e.execute(Select("k").from_("t").where({"v": None})).rows == [{"k": 2}]
    assert sources.find_dialect("postgres").driver == "org.postgresql.Driver" and sources.find_driver("none") is None
    other = type("Other", (), {"dialect": "other", "driver": "other", "open": lambda self, spark, **o: Engine(spark)})()
    sources.register(other)
    assert isinstance(sources.connect(spark, "other"), Engine)
    sources.unregister(other)
    with pytest.raises(ValueError):
        sources.connect(spark, "other")


def test_guards():
    from lathework.operators import guards

    assert guards.is_select(Select()) and guards.is_query(Union([])) and not guards.is_raw(Field("a")) and guards.is_join(LeftJoin("t")) and guards.is_aggregate(Count()) and guards.is_logical(And())


def test_sequences_number_rows(engine):
    rows = engine.execute(Select("n.n_nationkey", "r_name", Sequence("s").next().as_("id"), Case().when(Eq("n.n_nationkey", 3)).then(Sequence("s")).as_("now")).from_("nation n").join(InnerJoin("region r").on({"r.r_regionkey": Field("n.n_regionkey")})).order_by("-n.n_nationkey")).rows
    assert [r["id"] for r in rows] == list(range(1, 26)) and [r["n_nationkey"] for r in rows] == list(range(24, -1, -1))
    assert all(r["now"] == (r["id"] if r["n_nationkey"] == 3 else None) for r in rows)
    more = engine.execute(Select("*", Sequence("s").next().as_("id")).from_("region").where({"r_regionkey >": 1}).limit(2)).rows
    assert sorted(r["id"] for r in more) == [26, 27] and list(more[0]) == ["r_regionkey", "r_name", "id"]
    engine.execute(Insert("region", Select(Sequence("s").next().as_("r_regionkey"), "n_name r_name").from_("nation")))
    assert engine.execute(Select(Raw("count(distinct r_regionkey) as n"), Raw("max(r_regionkey) as top")).from_("region")).rows == [{"n": 30, "top": 52}]
    assert engine.execute(Select(Sequence("s").next().as_("x")).from_("region").where({"r_regionkey": -1})).rows == []


def test_returning_gives_what_was_written(engine):
    back = engine.execute(Insert("nation", Select(Raw("n_nationkey + 100.4 as n_nationkey"), "n_name").from_("nation").where({"n_regionkey": 1})).returning("n_nationkey", "n_name", "n_regionkey"))
    assert back.rows_affected == 5 and all(isinstance(r["n_nationkey"], int) and r["n_regionkey"] is None for r in back.rows)
    assert len(engine.execute(Update("nation", {"n_name": "X"}).returning("n_name"), fetch_rows=4).rows) == 4


def test_text_path_leaves_the_users_views(engine):
    engine.spark.range(3).createOrReplaceTempView("orders")
    try:
        q = Select("c_custkey").from_("customer c").where(Exists(Select(Raw("1")).from_("orders").where(Raw("orders.o_custkey = c.c_custkey"))))
        assert engine.dataframe(q).count() > 3
        assert engine.spark.table("orders").count() == 3
        assert not [t.name for t in engine.spark.catalog.listTables() if t.name.startswith("lathework_")]
    finally:
        engine.spark.catalog.dropTempView("orders")


def test_pretty_sql(engine):
    q = Select(*[f"c_custkey as column_{i}" for i in range(9)]).from_("customer").limit(1)
    assert "\n" in engine.execute(q, show_sql=True, pretty_print=True).sql and "\n" not in engine.execute(q, show_sql=True).sql
