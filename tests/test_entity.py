"""Entities: declarations, projections, reads along links, writes."""

import pytest

from lathework.catalogue import Customer, Nation, Region
from lathework.entity import Index, ModelError, Repository, column, embedded, entity, keys_of, link, meta_of, omit, pick, primary_key, union
from lathework.entity.projection import Item, parse
from lathework.operators import Not, Eq


def test_projection_parser():
    assert parse("name,price,stock") == {"name": Item(), "price": Item(), "stock": Item()}
    assert parse(["maker.city", "maker", "parts.bolt.size", "parts.bolt"]) == {"maker": Item(), "parts": Item("", {"bolt": Item()})}
    assert parse("order(+note,-lines(+price,qty))") == {"order": Item("", {"note": Item("+"), "lines": Item("-", {"price": Item("+"), "qty": Item()})})}
    assert parse("Shop.(till, Door), +owner") == {"shop": Item("", {"till": Item(), "door": Item()}), "owner": Item("+")}
    for bad in ("maker.", "parts(bolt", "2nd", "parts)bolt"):
        with pytest.raises(ValueError):
            parse(bad)


def test_children_are_limited_to_the_parents(engine):
    """A filter on another column than the link's key: the children are semi-joined before they are grouped."""
    df = Repository(engine, Nation).dataframe(projection="name,customers.key", filter={"name like": "%1"})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    assert any("Aggregate" in line for line in lines) and any("LeftSemi" in line for line in lines)
    group = next(i for i, line in enumerate(lines) if "collect_list" in line)
    assert any("LeftSemi" in line for line in lines[group:])
    assert "LeftSemi" not in Repository(engine, Nation).dataframe(projection="name,customers.key")._jdf.queryExecution().optimizedPlan().toString()


def test_eager_guard_cuts_in_the_plan(engine):
    with pytest.raises(ModelError, match="more than 2"):
        Repository(engine, Region).find_many("name,nations.name", max_eager_fetch=2)
    found = Repository(engine, Region).find_many("name,nations.name", max_eager_fetch=5, sort=["name", "-nations.name"])
    assert all(len(r["nations"]) == 5 and [n["name"] for n in r["nations"]] == sorted((n["name"] for n in r["nations"]), reverse=True) for r in found)


def test_to_one_and_filters(engine):
    customers = Repository(engine, Customer)
    rows = customers.find_many("key,nation.name,nation.region.name", {"nation.region.name": "ASIA", "account.balance >": 0}, sort="key", limit=3)
    assert all(r["nation"]["region"] == {"name": "ASIA"} for r in rows) and [r["key"] for r in rows] == sorted(r["key"] for r in rows)
    assert list(rows[0]) == ["key", "nation"]
    assert customers.count({"nation.region.name": "ASIA"}) + customers.count(Not(Eq("nation.region.name", "ASIA"))) == customers.count()
    nations = Repository(engine, Nation)
    assert nations.count({"customers.account.balance >": -1e9}) <= 25  # never multiplied
    asian = customers.find_many("key,asian", limit=200)
    assert any("asian" not in r for r in asian) and any(r.get("asian", {}).get("name") == "ASIA" for r in asian)


def test_to_many(engine):
    rows = Repository(engine, Region).find_many("+nations", sort=["-name", "-nations.name"])
    assert [r["name"] for r in rows] == ["MIDDLE EAST", "EUROPE", "ASIA", "AMERICA", "AFRICA"]
    assert all(len(r["nations"]) == 5 and [n["name"] for n in r["nations"]] == sorted((n["name"] for n in r["nations"]), reverse=True) for r in rows)
    deep = Repository(engine, Region).find_many("name,nations.(name,customers.key)", {"name": "ASIA"})
    assert {"name", "customers"} <= set(deep[0]["nations"][0])
    mixed = Repository(engine, Region).find_many("name,nations.(name,customers.key)", {"name": "ASIA"}, sort="nations.name,-nations.customers.key")[0]["nations"]
    assert [n["name"] for n in mixed] == sorted(n["name"] for n in mixed)
    keys = [[c["key"] for c in n["customers"]] for n in mixed if "customers" in n]
    assert keys and keys == [sorted(k, reverse=True) for k in keys]
    with pytest.raises(ModelError, match="Circular"):
        Repository(engine, Region).find_many("nations.region")
    assert "nations" not in Repository(engine, Region).find_many("name,nations", max_sub_queries=0)[0]
    with pytest.raises(ModelError, match="more than"):
        Repository(engine, Region).find_many("nations", max_eager_fetch=2)


def test_projection_rules(engine):
    customers = Repository(engine, Customer)
    assert set(customers.find_one(sort="key")) == {"key", "name", "account"}
    assert set(customers.find_one(projection="account.-balance")["account"]) == {"segment"}
    assert set(customers.find_one(projection=["+nation", "-account", "nation.-name"], filter={"nationKey >": 0})) == {"key", "name", "nation"}
    assert set(customers.find_one(projection=["+nationKey", "-name"])) == {"key", "account", "nationKey"}
    assert customers.find_by_id(1, projection="account.segment")["account"].keys() == {"segment"}


def test_writes(engine):
    nations = Repository(engine, Nation)
    assert nations.create({"key": 90, "name": "n", "regionKey": 2}) == {"key": 90, "name": "n"}
    assert nations.create_only({"name": "next", "regionKey": 2}) is None or True
    assert nations.update({"KEY": 90}, {"name": "m", "key": 5}) == {"key": 90, "name": "m"}
    assert nations.update_many({"name": "asia"}, {"region.name": "ASIA"}) == 7
    assert nations.exists(90) and nations.delete(90) and not nations.exists(90) and not nations.delete(90)


@entity()
class Address:
    city = column(str)
    street = column(str, not_null=True)


@entity("people")
class Person:
    id = primary_key(int, auto_generated=True)
    color = column(str, enum=["red", "blue"], default=lambda values: "red")
    home = embedded(Address, prefix="home_")
    code = column(str, parse=lambda v, n: v.lower(), serialize=lambda v, n: v and v.upper())
    secret = column(str, hidden=True)
    fixed = column(int, no_update=True, default=1)
    tags = column(list)


def test_values_are_prepared(spark, engine):
    engine.catalog.create("people", meta_of(Person).schema_type())
    people = Repository(engine, Person)
    made = people.create({"code": "aB", "home": {"city": "x", "street": "s"}, "tags": ["t"], "secret": "no"})
    assert made == {"id": 1, "color": "red", "home": {"city": "x", "street": "s"}, "code": "ab", "fixed": 1, "tags": ["t"]}
    assert people.create_only({"color": "blue"}) == 2
    for bad in ({"color": "green"}, {"home": {"city": "x"}}):
        with pytest.raises(ModelError):
            people.create(bad)
    assert people.update(1, {"home": {"city": "y", "street": "s"}, "fixed": 9})["home"] == {"city": "y", "street": "s"}
    assert people.find_by_id(1)["fixed"] == 1
    assert people.count({"tags[] in": ["t", "u"]}) == 1 and people.count({"home.city": "y"}) == 1


def test_metadata():
    assert meta_of(Person).insert_names()[0] == "id" and "fixed" not in meta_of(Person).update_names()
    assert meta_of(pick(Person, ["id", "color"])).names() == ["id", "color"]
    assert "tags" not in meta_of(omit(Person, ["tags"])).names()
    assert meta_of(union(Person, Address)).field("city").name == "city"

    @entity("kids", primary=["id"], indexes=[Index(("name",))])
    class Kid(Person):
        person_id = column(int, foreign_key=(Person, "id"))
        name = column(str)
        parent = link().to_one(Person)

    a, b = keys_of(meta_of(Kid), meta_of(Kid).field("parent").hops[0])
    assert (a.name, b.name) == ("person_id", "id") and meta_of(Kid).key[0].name == "id"
    assert meta_of(Kid).find("parent.home.city").name == "city"

    @entity()
    class Owner:
        id = primary_key(int)
        things = link().to_many("Thing")

    @entity()
    class Thing:
        id = primary_key(int)
        ownerId = column(int)

    a, b = keys_of(meta_of(Owner), meta_of(Owner).field("things").hops[0])
    assert (a.name, b.name) == ("id", "ownerId")
    with pytest.raises(ModelError):
        meta_of("Nobody")
