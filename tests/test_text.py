"""Query text, dialect by dialect."""

import datetime as dt

import pytest

from lathework.operators import *
from lathework.text import Extension, register, unregister


def sql(query, dialect=None, **options):
    return query.generate(dialect, **options).sql


@pytest.mark.parametrize(
    ("query", "text"),
    [
        (Select(), "select *"),
        (Select("*").add_column().from_("table1"), "select * from table1"),
        (Select("field1 f1, field2", ["field3", "field4 as f4"]).from_("t"), "select field1 as f1, field2, field3, field4 as f4 from t"),
        (Select("s.t.f x", "t.* y", "with").from_("s.t t"), 'select s.t.f as x, t.*, "with" from s.t t'),
        (Select("field1", "").from_("schema1.table1 t1", "").join(None).group_by("").order_by(""), "select field1 from schema1.table1 t1"),
        (Select(Raw("'John''s Bike' f1")).from_("table1"), "select 'John''s Bike' f1 from table1"),
        (Select(Select("id").from_("table2").as_("id2")).from_("table1"), "select (select id from table2) id2 from table1"),
        (Select().from_("table1", Raw("func1()")), "select * from table1,func1()"),
        (Select("id", "name").distinct().from_("t"), "select distinct id, name from t"),
        (Select().from_("t").where({"a": 1, "b": "x'y", "c !=": True}), "select * from t where a = 1 and b = 'x''y' and c != true"),
        (Select().from_("t").where(Or(And(Eq("a", 1), Eq("b", 2)), Eq("c", 3))), "select * from t where ((a = 1 and b = 2) or c = 3)"),
        (Select().from_("t").where({"or": [{"a": 1}, {"b": 2}]}), "select * from t where (a = 1 or b = 2)"),
        (Select().from_("t").where({"a in": []}, Between("b", []), None, {}), "select * from t"),
        (Select().from_("t").where(Between("b", 10)), "select * from t where b between 10 and 10"),
        (Select().from_("t").where({"b !btw": [1, 2]}), "select * from t where b not between 1 and 2"),
        (Select().from_("t").where(In("a", [1, "b"]), NotIn("c", 5)), "select * from t where a in (1,'b') and c not in (5)"),
        (Select().from_("t").where(Not(Like("a", 5)), Is("b", None)), "select * from t where not a like '5' and b is null"),
        (Select().from_("t").where(Exists(Select().from_("u"))), "select * from t where exists (select * from u)"),
        (Select().from_("t").where({"d": dt.datetime(2020, 1, 2), "e": dt.datetime(2020, 1, 2, 3, 4, 5)}), "select * from t where d = '2020-01-02' and e = '2020-01-02 03:04:05'"),
        (Select(Count().as_("n"), Max(Field("a")).as_("m"), Min("a")).from_("t").group_by("b"), "select count(*) n, max(a) m, min('a') from t group by b"),
        (Select(StringAgg("a").delimiter("&").order_by("a", "-b").as_("c")).from_("t"), "select string_agg(a,'&' order by a, b desc) c from t"),
        (Select(Case().when(Gt("a", 5), Lt("a", 9)).then(1).else_(None).as_("c")).from_("t"), "select case when a > 5 and a < 9 then 1 else null end c from t"),
        (Select(Case().as_("c"), Lower(""), Coalesce(Field("a"), 0)).from_("t"), "select coalesce(a, 0) from t"),
        (Select().from_("t").order_by("-a", "b desc", "+c", "d asc", Raw("e")), "select * from t order by a desc, b desc, c, d, e"),
        (Select().from_("a").join(InnerJoin("b").on(Eq("b.i", Field("a.i"))), LeftOuterJoin("s.c c"), CrossJoin("d")), "select * from a inner join b on b.i = a.i left outer join s.c c cross join d"),
        (Select().from_("a").join(LeftJoin(Select().from_("b").as_("x")).on(Eq("x.i", 1))), "select * from a left join (select * from b) x on x.i = 1"),
        (Union([Select("a").from_("t"), Select("b").from_("u")], "all"), "select a from t union all select b from u"),
        (Insert("t", {"a": 1, "b": None}).returning("id i"), "insert into t (a, b) values (1, null) returning id as i"),
        (Update("t", {"a": Raw("b + 1"), "c": "x"}).where({"id": 1}), "update t set a = b + 1, c = 'x' where id = 1"),
        (Delete("t").where({"id": 1}), "delete from t where id = 1"),
        (Select().comment("one\ntwo"), "/*one\n  two*/\nselect *"),
        (Select(Sequence("s").next().as_("n"), Sequence("s")), "select nextval('s') n, currval('s')"),
    ],
)
def test_plain(query, text):
    assert sql(query) == text


@pytest.mark.parametrize(
    ("query", "dialect", "text", "options"),
    [
        (Select().from_("t").where({"a": None, "b !=": None}), "postgres", "select * from t where a is null and b is not null", {}),
        (Select().from_("t").where({"a": None}), "sqlite", "select * from t where a = null", {}),
        (Select().from_("t").where({"a": Raw("null")}), "oracle", "select * from t where a is null", {}),
        (Select().from_("t").limit(5).offset(-3), "postgres", "select * from t LIMIT 5", {}),
        (Select().from_("t").limit(5).offset(2), "sqlite", "select * from t LIMIT 5 OFFSET 2", {}),
        (Select().from_("t").limit(5).offset(2), "mssql", "select * from t OFFSET 2 ROWS FETCH NEXT 5 ROWS ONLY", {}),
        (Select().from_("t").limit(5), "oracle", "select * from t FETCH FIRST 5 ROWS ONLY", {"dialect_version": "12"}),
        (Select().from_("t").limit(5), "oracle", "select * from (select * from t) where rownum <= 5", {}),
        (Select().from_("t").limit(5).offset(2), "oracle", "select * from (select /*+ first_rows(5) */ t.*, rownum row$number from (select * from t) t where rownum <= 7) where row$number >= 3", {}),
        (Select(), "oracle", "select * from dual", {}),
        (Select().from_("t").where({"a": True, "d": "2020-01-02"}), "oracle", "select * from t where a = 1 and d = to_date('2020-01-02', 'yyyy-mm-dd')", {}),
        (Select(StringAgg("a")).from_("t"), "oracle", "select listagg(a,',') within group (order by null) from t", {}),
        (Select(Sequence("s").next()), "oracle", "select s.nextval from dual", {}),
        (Select().from_(Table("t x", {"oracle": "index(:table i)"})), "oracle", "select /*+ index(x i) */ * from t x", {}),
        (Select().from_("t").where({"a": Param("x")}), "mssql", "select * from t where a = @x", {"params": {"x": 1}}),
        (Select().from_("t").where({"a in": Param("x")}), "postgres", "select * from t where a = ANY($1)", {"params": {"x": [1, 2]}}),
        (Select().from_("t").where({"a !in": Param("x")}), "postgres", "select * from t where a != ALL($1)", {"params": {"x": [1, 2]}}),
        (Select().from_("t").where({"a[] in": Param("x")}), "postgres", "select * from t where a && $1", {"params": {"x": [1, 2]}}),
        (Select().from_("t").where({"a[] in": Param("x")}), "postgres", "select * from t where $1 = ANY(a)", {"params": {"x": 1}}),
        (Select().from_("t").where({"a": Param("x")}), "postgres", "select * from t where a is null", {}),
        (Insert("t", {"a": 1}).returning("id"), "sqlite", "insert into t (a) values (1)", {}),
        (Select("select").from_("t").join(OuterJoin("u").on(Eq("t.a", Field("u.a")))), "spark", "select `select` from t full outer join u on t.a = u.a", {}),
    ],
)
def test_dialects(query, dialect, text, options):
    assert sql(query, dialect, **options) == text


def test_strict_params_bind_values():
    made = Select().from_("t").where({"a": 1, "b in": [1, 2]}).generate("postgres", strict_params=True)
    assert made.sql == "select * from t where a = $1 and b = ANY($2)"
    assert made.params == [1, [1, 2]]


def test_bad_uses():
    for call, message in (
        (lambda: Select().from_("t").join("u"), "Join statement required"), (lambda: sql(Select(Select().from_("u")).from_("t")), "Alias required"), (lambda: sql(Select().from_(Select().from_("u"))), "Alias required"),
        (lambda: Select().where({"a ??": 1}), "Unknown operator"), (lambda: Select("1abc"), "not a column"), (lambda: Select().order_by("a up"), "not a sort column"), (lambda: Select().where(5), "condition"),
        (lambda: Select().values([1]), "mapping"), (lambda: Insert("t", [1]), "mapping"), (lambda: Exists("x"), "Select or Raw"),
    ):
        with pytest.raises((TypeError, ValueError), match=message):
            call()


def test_hooks_and_extensions():
    q = Select("a").from_("t").on("serialize", lambda w, n, default: "hooked" if n.kind == "field" else None)
    assert sql(q) == "select hooked from t"
    own = Extension("mine", {"field": lambda w, n, default: f"<{default()}>"}, frozenset({"odd"}))
    register(own)
    try:
        assert sql(Select("a", "odd").from_("t"), "mine") == 'select <a>, <"odd"> from t'
    finally:
        unregister(own)
    assert sql(Select("a").from_("t"), "mine") == "select a from t"


def test_comments_by_dialect():
    q = Select().comment("x", ["oracle"]).comment("y")
    assert sql(q, "postgres") == "/*y*/\nselect *"


def test_pretty_text():
    wide = Select("station", *[f"measure_{i} m{i}" for i in range(9)]).from_("readings")
    where = Select("city").from_("stations").where(Eq("country", "one whose name takes a lot of room"), Eq("kind", "lighthouse"), Eq("height", 48), Eq("open", 1)).group_by("city", Raw("substr(city, 1, 3)"))
    nested = Select().from_(Select(*[f"measure_{i}" for i in range(8)]).from_("readings").as_("r"))
    insert = Insert("readings", {"station": 7, "measure_0": 2})
    for q in (wide, where, nested, insert):
        pretty = sql(q, pretty=True)
        assert " ".join(pretty.split()) == sql(q) and "\n" in pretty
        assert all(len(line) <= 80 for line in pretty.split("\n"))
    assert sql(wide, pretty=True).split("\n")[::len(sql(wide, pretty=True).split("\n")) - 1] == ["select", "from readings"]
    lines = sql(where, pretty=True).split("\n")
    assert lines[0] == "select city from stations" and lines[1].startswith("where country = ") and lines[1].endswith(" and") and lines[2].startswith("  ") and lines[-1] == "group by city, substr(city, 1, 3)"
    assert sql(nested, pretty=True).split("\n")[1].startswith("  (select")
    assert sql(Insert("t", Select("a", "b c").from_("u")), "spark") == "insert into t (a, c) select a, b as c from u"
