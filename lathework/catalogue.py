"""The query catalogue: one query for each operator, over the whole test tables, with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .entity import Repository, column, embedded, entity, link, meta_of, pick, primary_key, union
from .functions import renamed
from .migrate import Migrator, load
from .operators import (
    And, Between, Case, Coalesce, Count, CrossJoin, Delete, Eq, Exists, Field, FullOuterJoin, Gt, Gte, ILike, In, InnerJoin, Insert, Is, IsNot, LeftJoin, LeftOuterJoin, Like, Lower, Lt, Lte, Max,
    Min, Ne, Not, NotBetween, NotExists, NotILike, NotIn, NotLike, Or, OuterJoin, Param, Raw, RightJoin, RightOuterJoin, Select, Sequence, StringAgg, Table, Union, Update, Upper,
)
from .operators.types import DataType
from .runtime import ship
from .sources import Engine, connect

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
OBJECTS: dict[str, tuple[Callable[[], Any], dict[str, Any]]] = {}  # of the queries that are query objects
ORACLE: dict[str, str] = {}


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(ship(spark), sf_dir)


def _add(name: str, make: Callable[[], Any], sql: str | None, params: dict[str, Any] | None = None) -> None:
    """A query object, compiled by the engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _engine(spark, sf_dir).dataframe(make(), params)

    QUERIES[name], OBJECTS[name] = run, (make, params or {})
    if sql:
        ORACLE[name] = sql


def _run(name: str, sql: str | None) -> Callable[[Callable[[Engine], DataFrame]], Callable[[Engine], DataFrame]]:
    """A function of an engine."""

    def put(f: Callable[[Engine], DataFrame]) -> Callable[[Engine], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(_engine(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return put


CUSTOMER = "select c_custkey, c_acctbal from customer"


def _customers(*conditions: Any) -> Callable[[], Select]:
    return lambda: Select("c_custkey, c_acctbal").from_("customer").where(*conditions)


# -- projection and predicates

_add("select_project", lambda: Select("c_custkey id", "c_name").from_("customer"), "select c_custkey as id, c_name from customer")
_add("select_star", lambda: Select("*").from_("nation"), "select * from nation")
_add("select_table_star", lambda: Select("r.*", "n.n_name").from_("nation n").join(InnerJoin("region r").on({"r.r_regionkey": Field("n.n_regionkey")})), "select r.*, n.n_name from nation n join region r on r.r_regionkey = n.n_regionkey")
_add("select_no_table", lambda: Select(Raw("1 + 1 as two"), Raw("'x' as letter")), "select 1 + 1 as two, 'x' as letter")
_add("where_eq", _customers({"c_nationkey": 3}), f"{CUSTOMER} where c_nationkey = 3")
_add("where_ne", _customers(Ne("c_nationkey", 3)), f"{CUSTOMER} where c_nationkey <> 3")
_add("where_gt", _customers(Gt("c_acctbal", 5000)), f"{CUSTOMER} where c_acctbal > 5000")
_add("where_gte", _customers({"c_acctbal >=": 5000}), f"{CUSTOMER} where c_acctbal >= 5000")
_add("where_lt", _customers(Lt("c_acctbal", 0)), f"{CUSTOMER} where c_acctbal < 0")
_add("where_lte", _customers(Lte("c_acctbal", 0)), f"{CUSTOMER} where c_acctbal <= 0")
_SPARSE = "(select r_regionkey, case when r_regionkey > 2 then r_name end x from region) t"


def _sparse() -> Select:
    return Select("r_regionkey", Case().when(Gt("r_regionkey", 2)).then(Field("r_name")).as_("x")).from_("region").as_("t")


_add("where_null_rewrite", lambda: Select("r_regionkey").from_(_sparse()).where({"t.x": None}), f"select r_regionkey from {_SPARSE} where t.x is null")
_add("where_not_null_rewrite", lambda: Select("r_regionkey").from_(_sparse()).where({"t.x !=": None}), f"select r_regionkey from {_SPARSE} where t.x is not null")
_add("null_param_rewrite", lambda: Select("r_regionkey").from_(_sparse()).where(Eq("t.x", Param("p"))), f"select r_regionkey from {_SPARSE} where t.x is null", {"p": None})
_add("raw_null_rewrite", lambda: Select("r_regionkey").from_(_sparse()).where(Ne("t.x", Raw("null"))), f"select r_regionkey from {_SPARSE} where t.x is not null")
_add("between", _customers(Between("c_acctbal", 100, 900)), f"{CUSTOMER} where c_acctbal between 100 and 900")
_add("between_single", lambda: Select("c_custkey").from_("customer").where(Between("c_nationkey", 7)), "select c_custkey from customer where c_nationkey between 7 and 7")
_add("between_filter", _customers({"c_acctbal btw": [100, 900]}), f"{CUSTOMER} where c_acctbal between 100 and 900")
_add("not_between", _customers(NotBetween("c_acctbal", [0, 9000])), f"{CUSTOMER} where c_acctbal not between 0 and 9000")
_add("in_list", _customers({"c_nationkey in": [1, 2, 3]}), f"{CUSTOMER} where c_nationkey in (1, 2, 3)")
_add("in_scalar", _customers(In("c_nationkey", 4)), f"{CUSTOMER} where c_nationkey in (4)")
_add("eq_list", _customers(Eq("c_nationkey", [1, 5])), f"{CUSTOMER} where c_nationkey in (1, 5)")
_add("not_in_list", _customers(NotIn("c_nationkey", [1, 2, 3])), f"{CUSTOMER} where c_nationkey not in (1, 2, 3)")
_add("in_empty", _customers({"c_nationkey in": []}), CUSTOMER)
_add("in_subquery", lambda: Select("n_name").from_("nation").where(In("n_regionkey", Select("r_regionkey").from_("region").where({"r_name like": "A%"}))), "select n_name from nation where n_regionkey in (select r_regionkey from region where r_name like 'A%')")
_add("not_in_subquery", lambda: Select("n_name").from_("nation").where({"n_regionkey !in": Select("r_regionkey").from_("region").where({"r_name like": "A%"})}), "select n_name from nation where n_regionkey not in (select r_regionkey from region where r_name like 'A%')")
_add("like", lambda: Select("p_partkey, p_type").from_("part").where(Like("p_type", "%A%")), "select p_partkey, p_type from part where p_type like '%A%'")
_add("not_like", lambda: Select("p_partkey").from_("part").where(NotLike("p_type", "%A%")), "select p_partkey from part where p_type not like '%A%'")
_add("ilike", lambda: Select("r_name").from_("region").where(ILike("r_name", "a%")), "select r_name from region where r_name ilike 'a%'")
_add("not_ilike", lambda: Select("r_name").from_("region").where(NotILike("r_name", "a%")), "select r_name from region where r_name not ilike 'a%'")
_add("is_null", lambda: Select("r_regionkey").from_(_sparse()).where(Is("t.x", None)), f"select r_regionkey from {_SPARSE} where t.x is null")
_add("is_not_null", lambda: Select("r_regionkey").from_(_sparse()).where(IsNot("t.x", None)), f"select r_regionkey from {_SPARSE} where t.x is not null")
_add("is_value", lambda: Select("r_regionkey").from_(_sparse()).where(IsNot("t.x", "EUROPE")), f"select r_regionkey from {_SPARSE} where t.x is distinct from 'EUROPE'")
_add("not", lambda: Select("r_name").from_("region").where(Not(Or(Eq("r_regionkey", 1), Eq("r_regionkey", 2)))), "select r_name from region where not (r_regionkey = 1 or r_regionkey = 2)")
_add(
    "and_or_nested", _customers({"or": [{"and": {"c_nationkey": 1, "c_acctbal >": 0}}, {"and": [{"c_nationkey": 2}, {"c_acctbal <": 0}]}]}),
    f"{CUSTOMER} where (c_nationkey = 1 and c_acctbal > 0) or (c_nationkey = 2 and c_acctbal < 0)",
)
_add("or_takes_all_keys", _customers({"or": [{"c_nationkey": 1, "c_acctbal <": -900}, {"c_nationkey": 2}]}), f"{CUSTOMER} where c_nationkey = 1 or c_acctbal < -900 or c_nationkey = 2")
_add("where_accumulates", lambda: Select("c_custkey").from_("customer").where({"c_nationkey": 1}).where(Gte("c_acctbal", 0), None, {}), "select c_custkey from customer where c_nationkey = 1 and c_acctbal >= 0")
_add("exists", lambda: Select("c_custkey").from_("customer c").where(Exists(Select(Raw("1")).from_("orders o").where({"o.o_custkey": Field("c.c_custkey"), "o.o_totalprice >": 300000}))), "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000)")
_add("not_exists", lambda: Select("c_custkey").from_("customer c").where(NotExists(Select(Raw("1")).from_("orders o").where({"o.o_custkey": Field("c.c_custkey")}))), "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
_add("raw_outer", lambda: Select("c_custkey").from_("customer c").where(Exists(Select(Raw("1")).from_("orders o").where(Raw("o.o_custkey = c.c_custkey and o.o_totalprice > 300000")))), "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000)")
_add(
    "exists_or_exists",
    lambda: Select("n_name").from_("nation n").where(
        Or(Exists(Select().from_("customer c").where({"c.c_nationkey": Field("n.n_nationkey"), "c.c_acctbal >": 9990})), {"exists": Select().from_("region r").where({"r.r_regionkey": Field("n.n_regionkey"), "r.r_name": "ASIA"})})
    ),
    "select n_name from nation n where exists (select 1 from customer c where c.c_nationkey = n.n_nationkey and c.c_acctbal > 9990) or exists (select 1 from region r where r.r_regionkey = n.n_regionkey and r.r_name = 'ASIA')",
)


def _lists() -> Select:
    return Select("v.vec_id", Raw("array(v.label, v.label + 1) as tags")).from_("embeddings v").as_("t")


_add("array_contains", lambda: Select("vec_id").from_(_lists()).where({"t.tags[] in": Param("x")}), "select vec_id from (select vec_id, [label, label + 1] as tags from embeddings) t where list_contains(tags, 3)", {"x": 3})
_add("array_overlap", lambda: Select("vec_id").from_(_lists()).where({"t.tags[] in": [3, 7]}), "select vec_id from (select vec_id, [label, label + 1] as tags from embeddings) t where list_has_any(tags, [3, 7])")
_add("array_not_overlap", lambda: Select("vec_id").from_(_lists()).where({"t.tags[] !in": [3, 7]}), "select vec_id from (select vec_id, [label, label + 1] as tags from embeddings) t where not list_has_any(tags, [3, 7])")
_add("compare_subselect", lambda: Select("c_custkey").from_("customer").where(Gt("c_acctbal", Select(Raw("avg(c_acctbal)")).from_("customer"))), "select c_custkey from customer where c_acctbal > (select avg(c_acctbal) from customer)")
_add("compare_raw", lambda: Select("c_custkey").from_("customer").where(Eq(Raw("c_custkey % 7"), 0)), "select c_custkey from customer where c_custkey % 7 = 0")
_add("params", _customers(And(Eq("c_nationkey", Param("n")), Gt("c_acctbal", Param("b", DataType.DOUBLE)))), f"{CUSTOMER} where c_nationkey = 5 and c_acctbal > 100.0", {"n": 5, "b": 100})
_add("array_param", _customers(In("c_nationkey", Param("n", is_array=True))), f"{CUSTOMER} where c_nationkey in (5, 6)", {"n": [5, 6]})

# -- joins


def _nations(join: Any, on: Any = None) -> Callable[[], Select]:
    def make() -> Select:
        side = Select("n_nationkey", "n_name", "n_regionkey").from_("nation").where({"n_regionkey <": 3}).as_("n")
        few = Select("r_regionkey", "r_name").from_("region").where({"r_regionkey >": 0}).as_("r")
        j = join(few)
        if on is not False:
            j.on(on or {"r.r_regionkey": Field("n.n_regionkey")})
        return Select("n.n_name", "r.r_name").from_(side).join(j)

    return make


_SIDES = "from (select * from nation where n_regionkey < 3) n {} join (select * from region where r_regionkey > 0) r on r.r_regionkey = n.n_regionkey"
for _name, _join, _word in (
    ("inner_join", InnerJoin, "inner"), ("left_join", LeftJoin, "left"), ("left_outer_join", LeftOuterJoin, "left outer"), ("right_join", RightJoin, "right"),
    ("right_outer_join", RightOuterJoin, "right outer"), ("outer_join", OuterJoin, "full outer"), ("full_outer_join", FullOuterJoin, "full outer"),
):
    _add(_name, _nations(_join), "select n.n_name, r.r_name " + _SIDES.format(_word))
_add("cross_join", lambda: Select("n.n_name", "r.r_name").from_("nation n").join(CrossJoin("region r")), "select n.n_name, r.r_name from nation n cross join region r")
_add("comma_join", lambda: Select("n.n_name", "r.r_name").from_("nation n", "region r").where({"r.r_regionkey": Field("n.n_regionkey")}), "select n.n_name, r.r_name from nation n, region r where r.r_regionkey = n.n_regionkey")
_add("join_without_on", _nations(InnerJoin, False), "select n.n_name, r.r_name from (select * from nation where n_regionkey < 3) n cross join (select * from region where r_regionkey > 0) r")
_add("join_theta", lambda: Select("a.r_name x", "b.r_name y").from_("region a").join(InnerJoin("region b").on(Lt("a.r_regionkey", Field("b.r_regionkey")))), "select a.r_name as x, b.r_name as y from region a join region b on a.r_regionkey < b.r_regionkey")
_add(
    "join_subselect",
    lambda: Select("c.c_name", "o.total").from_("customer c").join(InnerJoin(Select("o_custkey", Max(Field("o_totalprice")).as_("total")).from_("orders").group_by("o_custkey").as_("o")).on({"o.o_custkey": Field("c.c_custkey")})),
    "select c.c_name, o.total from customer c join (select o_custkey, max(o_totalprice) as total from orders group by o_custkey) o on o.o_custkey = c.c_custkey",
)
_add(
    "join_chain",
    lambda: Select("o.o_orderkey", "c.c_name", "r.r_name").from_("orders o").join(InnerJoin("customer c").on({"c.c_custkey": Field("o.o_custkey")}), InnerJoin("nation n").on({"n.n_nationkey": Field("c.c_nationkey")}), LeftJoin("region r").on({"r.r_regionkey": Field("n.n_regionkey")})).where({"r.r_name": "EUROPE"}),
    "select o.o_orderkey, c.c_name, r.r_name from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey left join region r on r.r_regionkey = n.n_regionkey where r.r_name = 'EUROPE'",
)
_add("hinted_table", lambda: Select("n.n_name", "r.r_name").from_("nation n").join(InnerJoin(Table("region r", "merge")).on({"r.r_regionkey": Field("n.n_regionkey")})), "select n.n_name, r.r_name from nation n join region r on r.r_regionkey = n.n_regionkey")

# -- sources

_add("derived_table", lambda: Select("t.k", "t.b").from_(Select("c_custkey k", "c_acctbal b").from_("customer").where({"c_acctbal >": 9000}).as_("t")), "select k, b from (select c_custkey as k, c_acctbal as b from customer where c_acctbal > 9000) t")
_add("scalar_subselect", lambda: Select("r.r_name", Select(Count()).from_("nation n").where({"n.n_regionkey": Field("r.r_regionkey")}).as_("nations")).from_("region r"), "select r.r_name, (select count(*) from nation n where n.n_regionkey = r.r_regionkey) as nations from region r")
_add("union_source", lambda: Select("u.x").from_(Union([Select("r_name x").from_("region"), Select("n_name").from_("nation")], "all").as_("u")).where({"u.x like": "A%"}), "select x from (select r_name as x from region union all select n_name from nation) u where x like 'A%'")
_add("raw_from", lambda: Select("id").from_(Raw("range(5)")), "select range as id from range(5)")
_add("raw_projection", lambda: Select("o_orderkey", Raw("round(o_totalprice * 2, 1) as twice")).from_("orders"), "select o_orderkey, round(o_totalprice * 2, 1) as twice from orders")

# -- set operations, order and paging

_add("union", lambda: Union([Select("n_regionkey k").from_("nation"), Select("r_regionkey").from_("region")]), "select n_regionkey as k from nation union select r_regionkey from region")
_add("union_all", lambda: Union([Select("n_regionkey k").from_("nation"), Select("r_regionkey").from_("region")], "all"), "select n_regionkey as k from nation union all select r_regionkey from region")
_add("distinct", lambda: Select("c_nationkey, c_mktsegment").distinct().from_("customer"), "select distinct c_nationkey, c_mktsegment from customer")
_add("order_by", lambda: Select("c_custkey").from_("customer").order_by("-c_acctbal", "c_custkey asc").limit(100), "select c_custkey from customer order by c_acctbal desc, c_custkey limit 100")
_add("order_raw", lambda: Select("r_name").from_("region").order_by(Raw("length(r_name)"), "r_name").limit(2), "select r_name from region order by length(r_name), r_name limit 2")
_add("limit_offset", lambda: Select("c_custkey").from_("customer").order_by("c_custkey").offset(10).limit(20), "select c_custkey from customer order by c_custkey limit 20 offset 10")
_add("topk", lambda: Select("o_orderkey, o_totalprice").from_("orders").order_by("o_totalprice desc", "o_orderkey").limit(50), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
_add("null_order", lambda: Select("t.r_regionkey").from_(_sparse()).order_by("-t.x", "t.r_regionkey").limit(4), f"select r_regionkey from {_SPARSE} order by x desc nulls first, r_regionkey limit 4")

# -- aggregates and scalar functions

_add("count", lambda: Select(Count().as_("n")).from_("lineitem"), "select count(*) as n from lineitem")
_add("min_max", lambda: Select(Min(Field("l_shipdate")).as_("first"), Max(Field("l_extendedprice")).as_("top")).from_("lineitem"), "select min(l_shipdate) as first, max(l_extendedprice) as top from lineitem")
_add("group_by", lambda: Select("l_returnflag", "l_linestatus", Count().as_("n"), Max(Field("l_quantity")).as_("q")).from_("lineitem").group_by("l_returnflag", "l_linestatus"), "select l_returnflag, l_linestatus, count(*) as n, max(l_quantity) as q from lineitem group by l_returnflag, l_linestatus")
_add(
    "group_by_raw", lambda: Select(Raw("year(o_orderdate) as y"), Raw("cast(round(sum(o_totalprice)) as bigint) as total"), Count().as_("n")).from_("orders").group_by(Raw("year(o_orderdate)")),
    "select cast(year(o_orderdate) as integer) as y, cast(round(sum(o_totalprice)) as bigint) as total, count(*) as n from orders group by 1",
)
_add("group_order", lambda: Select("c_mktsegment", Count().as_("n")).from_("customer").group_by("c_mktsegment").order_by("-n", "c_mktsegment").limit(3), "select c_mktsegment, count(*) as n from customer group by c_mktsegment order by n desc, c_mktsegment limit 3")
_add("string_agg_ordered", lambda: Select("n_regionkey", StringAgg("n_name").delimiter("; ").order_by("-n_name").as_("names")).from_("nation").group_by("n_regionkey"), "select n_regionkey, string_agg(n_name, '; ' order by n_name desc) as names from nation group by n_regionkey")
_add("string_agg_by_other", lambda: Select(StringAgg(Field("n_name"), "|").order_by("n_regionkey", "-n_nationkey").as_("names")).from_("nation"), "select string_agg(n_name, '|' order by n_regionkey, n_nationkey desc) as names from nation")
_add(
    "case", lambda: Select("c_custkey", Case().when(Lt("c_acctbal", 0)).then("debt").when(Gte("c_acctbal", 0), Lt("c_acctbal", 5000)).then("some").else_("rich").as_("level")).from_("customer"),
    "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal >= 0 and c_acctbal < 5000 then 'some' else 'rich' end as level from customer",
)
_add("coalesce", lambda: Select("t.r_regionkey", Coalesce(Field("t.x"), "none").as_("x")).from_(_sparse()), f"select r_regionkey, coalesce(x, 'none') as x from {_SPARSE}")
_add("lower_upper", lambda: Select(Lower(Field("r_name")).as_("low"), Upper(Field("r_name")).as_("up"), Upper("text").as_("literal")).from_("region"), "select lower(r_name) as low, upper(r_name) as up, 'TEXT' as literal from region")
_add("sequence", lambda: Select(Sequence("counter").next().as_("a"), Sequence("counter").next().as_("b"), Sequence("counter").as_("c")), "select 1 as a, 2 as b, 2 as c")

_add("sequence_rows", lambda: Select("n_nationkey", Sequence("rows").next().as_("a"), Sequence("rows").next().as_("b"), Sequence("rows").as_("c")).from_("nation").order_by("-n_name"), "select n_nationkey, 2 * r - 1 as a, 2 * r as b, 2 * r as c from (select n_nationkey, row_number() over (order by n_name desc) r from nation)")

# -- text back-end run by Spark


@_run("spark_text", "select c_custkey from customer where c_nationkey in (1, 2) and c_acctbal > 100 order by c_acctbal desc limit 10")
def _spark_text(e: Engine) -> DataFrame:
    e.catalog.table(None, "customer").createOrReplaceTempView("customer")
    made = Select("c_custkey").from_("customer").where({"c_nationkey in": [1, 2], "c_acctbal >": Param("b")}).order_by("-c_acctbal").limit(10).generate("spark", {"b": 100})
    return e.spark.sql(made.sql, args=made.params)


# -- writes


@_run("insert_row", "select * from nation union all select 99, 'NEW', null")
def _insert_row(e: Engine) -> DataFrame:
    e.execute(Insert("nation", {"n_nationkey": 99, "n_name": "NEW"}))
    return e.dataframe(Select().from_("nation"))


@_run("insert_select", "select r_regionkey, r_name from region union all select n_nationkey + 100, n_name from nation where n_regionkey = 1")
def _insert_select(e: Engine) -> DataFrame:
    e.execute(Insert("region", Select(Raw("n_nationkey + 100 as r_regionkey"), "n_name r_name").from_("nation").where({"n_regionkey": 1})))
    return e.dataframe(Select("r_regionkey", "r_name").from_("region"))


@_run("update", "select n_nationkey, case when n_regionkey = 2 then 'X' else n_name end as n_name, n_regionkey from nation")
def _update(e: Engine) -> DataFrame:
    e.execute(Update("nation", {"n_name": "X"}).where({"n_regionkey": 2}))
    return e.dataframe(Select().from_("nation"))


@_run("update_subselect", "select n_nationkey, case when n_regionkey = 2 then (select r_name from region r where r.r_regionkey = n.n_regionkey) else n_name end as n_name, n_regionkey from nation n")
def _update_subselect(e: Engine) -> DataFrame:
    e.execute(Update("nation n", {"n_name": Select("r.r_name").from_("region r").where({"r.r_regionkey": Field("n.n_regionkey")})}).where({"n.n_regionkey": 2}))
    return e.dataframe(Select().from_("nation"))


@_run("update_returning", "select n_nationkey as k, 'X' as n_name from nation where n_regionkey = 2")
def _update_returning(e: Engine) -> DataFrame:
    return e.spark.createDataFrame(e.execute(Update("nation", {"n_name": "X"}).where({"n_regionkey": 2}).returning("n_nationkey k", "n_name")).rows, "k int, n_name string")


@_run("insert_returning", "select 99 as n_nationkey, 'NEW' as label, cast(null as integer) as n_regionkey")
def _insert_returning(e: Engine) -> DataFrame:
    back = e.execute(Insert("nation", {"n_nationkey": Raw("98L + 1"), "n_name": "NEW"}).returning("n_nationkey", "n_name label", "n_regionkey"))
    return e.spark.createDataFrame(back.rows, "n_nationkey int, label string, n_regionkey int")


def _in_files(e: Engine) -> Engine:
    """``orders`` in several files: writes touch those with affected rows only."""
    orders = e.dataframe(Select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").from_("orders"))
    e.catalog.register("many", orders.repartitionByRange(6, "o_orderkey"))
    return e


@_run("update_files", "select o_orderkey, o_custkey, case when o_orderkey < 3000 and o_totalprice > 1000 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice from orders")
def _update_files(e: Engine) -> DataFrame:
    _in_files(e).execute(Update("many", {"o_orderstatus": "X"}).where({"o_orderkey <": 3000, "o_totalprice >": 1000}))
    return e.dataframe(Select().from_("many"))


@_run("delete_files", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey >= 3000 or o_totalprice <= 1000")
def _delete_files(e: Engine) -> DataFrame:
    _in_files(e).execute(Delete("many").where({"o_orderkey <": 3000, "o_totalprice >": 1000}))
    return e.dataframe(Select().from_("many"))


@_run("write_counts", "select 1 as inserted, 5 as updated, 20 as deleted, 6 as remaining")
def _write_counts(e: Engine) -> DataFrame:
    made = e.execute(Insert("nation", {"n_nationkey": 99, "n_name": "NEW", "n_regionkey": 2})).rows_affected
    changed = e.execute(Update("nation", {"n_name": "X"}).where({"n_regionkey": 1})).rows_affected
    gone = e.execute(Delete("nation").where({"n_regionkey !=": 2})).rows_affected
    return e.dataframe(Select(Raw(f"{made} as inserted"), Raw(f"{changed} as updated"), Raw(f"{gone} as deleted"), Raw("cast(count(*) as int) as remaining")).from_("nation"))


@_run("delete", "select * from nation where n_regionkey <> 2")
def _delete(e: Engine) -> DataFrame:
    e.execute(Delete("nation").where({"n_regionkey": 2}))
    return e.dataframe(Select().from_("nation"))


@_run("delete_keeps_unknown", "select 1 as k, cast(null as varchar) as v union all select 3, 'c'")
def _delete_unknown(e: Engine) -> DataFrame:
    e.catalog.register("t", e.spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "k int, v string"))
    e.execute(Delete("t").where({"v": "b"}))
    return e.dataframe(Select().from_("t"))


@_run("transaction_rollback", "select (select count(*) from nation) - 5 as inside, (select count(*) from nation) as after")
def _transaction(e: Engine) -> DataFrame:
    e.start_transaction()
    e.execute(Delete("nation").where({"n_regionkey": 0}))
    e.set_savepoint("a")
    e.execute(Delete("nation"))
    e.rollback_to_savepoint("a")
    inside = e.dataframe(Select(Count().as_("inside")).from_("nation")).first()[0]
    e.rollback()
    return e.dataframe(Select(Raw(f"{inside}L as inside"), Count().as_("after")).from_("nation"))


# -- result layer


@_run("naming_camel", 'select n_nationkey as "nNationkey", n_name as "nName", n_regionkey as "nRegionkey" from nation')
def _naming(e: Engine) -> DataFrame:
    return renamed(e.dataframe(Select().from_("nation")), "camelcase")


@_run("fetch_as_string", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate from orders")
def _strings(e: Engine) -> DataFrame:
    return e._as_strings(e.dataframe(Select("o_orderkey", "o_orderdate").from_("orders")), (DataType.TIMESTAMP,))


@_run("fetch_cap", "select 100 as capped, 7 as asked, (select count(*) from customer) as uncapped")
def _fetch_cap(e: Engine) -> DataFrame:
    q = Select("c_custkey").from_("customer")
    sizes = [len(e.execute(q, fetch_rows=n).rows) for n in (None, 7, 0)]
    return e.spark.createDataFrame([sizes], "capped int, asked int, uncapped long")


@_run("row_shapes", "select r_regionkey as key, r_name as name, case when r_regionkey > 2 then 2 else 1 end as n from region")
def _row_shapes(e: Engine) -> DataFrame:
    lists = e.execute(Select("r_regionkey", "r_name").from_("region").order_by("r_regionkey"), object_rows=False).rows
    objects = e.execute(Select("t.r_regionkey k", "t.x").from_(_sparse()).order_by("k"), ignore_nulls=True).rows
    return e.spark.createDataFrame([(*row, len(o)) for row, o in zip(lists, objects, strict=True)], "key int, name string, n int")


@_run("row_transform", "select upper(r_name) as r_name from region")
def _row_transform(e: Engine) -> DataFrame:
    rows = e.execute(Select("r_name").from_("region"), transform=lambda v, info: v.upper() if isinstance(v, str) else v).rows
    return e.spark.createDataFrame([(r["r_name"],) for r in rows], "r_name string")


@_run("cursor", "select c_custkey from customer order by c_custkey limit 250")
def _cursor(e: Engine) -> DataFrame:
    cursor = e.execute(Select("c_custkey").from_("customer").order_by("c_custkey").limit(250), cursor=True, fetch_rows=60).cursor
    rows = []
    while (row := cursor.next()) is not None:
        rows.append((row["c_custkey"],))
    cursor.close()
    return e.spark.createDataFrame(rows, "c_custkey long")


# -- entities


@entity("region")
class Region:
    key = primary_key(int, field_name="r_regionkey")
    name = column(str, field_name="r_name")
    nations = link(exclusive=True).to_many("Nation", "key", "regionKey")


@entity("nation")
class Nation:
    key = primary_key(int, field_name="n_nationkey")
    name = column(str, field_name="n_name")
    regionKey = column(int, field_name="n_regionkey", exclusive=True)
    region = link(exclusive=True).to_one(Region, "regionKey", "key")
    customers = link(exclusive=True).to_many("Customer", "key", "nationKey")


@entity()
class Account:
    balance = column(float, field_name="acctbal")
    segment = column(str, field_name="mktsegment")


@entity("customer")
class Customer:
    key = primary_key(int, field_name="c_custkey")
    name = column(str, field_name="c_name")
    account = embedded(Account, "c_")
    nationKey = column(int, field_name="c_nationkey", exclusive=True)
    nation = link(exclusive=True).to_one(Nation, "nationKey", "key")
    asian = link(exclusive=True).to_one(Nation, "nationKey", "key").to_one(Region, "regionKey", "key", where={"name": "ASIA"})
    orders = link(exclusive=True).to_many("Order", "key", "customerKey")


@entity("orders")
class Order:
    key = primary_key(int, field_name="o_orderkey")
    customerKey = column(int, field_name="o_custkey")
    total = column(float, field_name="o_totalprice")
    customer = link(exclusive=True).to_one(Customer, "customerKey", "key")


def _entity(name: str, cls: type, columns: list[str], sql: str, **options: Any) -> None:
    """A repository read, its struct flattened to ``columns`` (path or ``path as name``)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Repository(_engine(spark, sf_dir), cls).dataframe(**options)
        picked = [c.split(" as ") for c in columns]
        return df.select(*[F.col(f"_row.{p[0]}").alias(p[-1].split(".")[-1]) for p in picked])

    QUERIES[name], ORACLE[name] = run, sql


_entity("entity_find", Customer, ["key", "name"], "select c_custkey as key, c_name as name from customer where c_nationkey = 4", filter={"nationKey": 4})
_entity("entity_projection_sign", Customer, ["key", "nationKey", "account.segment"], 'select c_custkey as key, c_nationkey as "nationKey", c_mktsegment as segment from customer', projection=["+nationKey", "-name"])
_entity("entity_embedded", Customer, ["key", "account.balance"], "select c_custkey as key, c_acctbal as balance from customer where c_acctbal > 9000", projection="key,account.balance", filter={"account.balance >": 9000})
_entity("entity_to_one", Customer, ["key", "nation.name as nation"], "select c_custkey as key, n_name as nation from customer left join nation on n_nationkey = c_nationkey", projection="key,nation.name")
_entity(
    "entity_chain", Customer, ["key", "asian.name as region"],
    "select c_custkey as key, r_name as region from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey and r_name = 'ASIA'", projection="key,asian.name",
)
_entity(
    "entity_filter_path", Customer, ["key"],
    "select c_custkey as key from customer where c_nationkey in (select n_nationkey from nation join region on r_regionkey = n_regionkey where r_name = 'ASIA')", projection="key", filter={"nation.region.name": "ASIA"},
)
_entity(
    "entity_filter_path_or", Nation, ["key"],
    "select n_nationkey as key from nation where n_regionkey = 1 or n_nationkey in (select c_nationkey from customer where c_acctbal > 9900)", projection="key", filter={"or": [{"region.key": 1}, {"customers.account.balance >": 9900}]},
)
_entity(
    "entity_sort_path", Customer, ["key"],
    "select c_custkey as key from customer join nation on n_nationkey = c_nationkey order by n_name desc, c_custkey limit 25", projection="key", sort=["-nation.name", "key"], limit=25,
)
_entity("entity_distinct", Customer, ["account.segment"], "select distinct c_mktsegment as segment from customer", projection="account.segment", distinct=True)
_entity("entity_paging", Customer, ["key"], "select c_custkey as key from customer order by c_custkey limit 7 offset 3", projection="key", sort="key", offset=3, limit=7)


@_run("entity_to_many", "select r_name as region, n_name as nation from region left join nation on n_regionkey = r_regionkey")
def _to_many(e: Engine) -> DataFrame:
    df = Repository(e, Region).dataframe(projection="name,nations.name")
    return df.select(F.col("_row.name").alias("region"), F.explode_outer("_m0").alias("n")).select("region", F.col("n._row.name").alias("nation"))


@_run("entity_to_many_sorted", "select r_name as region, string_agg(n_name, ',' order by n_name desc) as nations from region left join nation on n_regionkey = r_regionkey group by r_name")
def _to_many_sorted(e: Engine) -> DataFrame:
    df = Repository(e, Region).dataframe(projection="name,nations.name", sort=["-nations.name"])
    return df.select(F.col("_row.name").alias("region"), F.array_join(F.transform("_m0", lambda n: n["_row"]["name"]), ",").alias("nations"))


@_run("entity_count", "select (select count(*) from customer where c_acctbal < 0) as n, true as any")
def _count(e: Engine) -> DataFrame:
    r = Repository(e, Customer)
    return e.spark.createDataFrame([(r.count({"account.balance <": 0}), r.exists(1))], "n long, any boolean")


@_run("entity_writes", "select n_nationkey as key, case when n_nationkey = 3 then 'renamed' else n_name end as name from nation where n_nationkey <> 5 union all select 77, 'created'")
def _entity_writes(e: Engine) -> DataFrame:
    r = Repository(e, Nation)
    r.create_only({"key": 77, "name": "created", "regionKey": 1})
    r.update_only(3, {"name": "renamed"})
    r.delete(5)
    return r.dataframe(projection="key,name").select("_row.key", "_row.name")


@_run("entity_to_many_filtered", "select n_name as nation, c_custkey as customer from nation left join customer on c_nationkey = n_nationkey where n_name like '%1'")
def _to_many_filtered(e: Engine) -> DataFrame:
    """Children are semi-joined with the parents that a filter on another column leaves."""
    df = Repository(e, Nation).dataframe(projection="name,customers.key", filter={"name like": "%1"})
    return df.select(F.col("_row.name").alias("nation"), F.explode_outer("_m0").alias("c")).select("nation", F.col("c._row.key").alias("customer"))


@_run("entity_to_many_nested", "select r_name as region, n_name as nation, c_custkey as customer from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey where r_name = 'ASIA'")
def _to_many_nested(e: Engine) -> DataFrame:
    df = Repository(e, Region).dataframe(projection="name,nations.(name,customers.key)", filter={"name": "ASIA"})
    rows = df.select(F.col("_row.name").alias("region"), F.explode_outer("_m0").alias("n"))
    return rows.select("region", F.col("n._row.name").alias("nation"), F.explode_outer("n._m0").alias("c")).select("region", "nation", F.col("c._row.key").alias("customer"))


def _objects(name: str, kinds: str, sql: str) -> Callable[[Callable[[Engine], list[tuple]]], None]:
    """A function of an engine that returns rows."""
    return lambda f: _run(name, sql)(lambda e: e.spark.createDataFrame(f(e), kinds))


@_objects("entity_create", "key int, name string", "select 78 as key, 'created' as name union all select 79, 'also'")
def _entity_create(e: Engine) -> list[tuple]:
    r = Repository(e, Nation)
    return [tuple(r.create({"key": k, "name": n, "regionKey": 1}, projection="key,name").values()) for k, n in ((78, "created"), (79, "also"))]


@_objects("entity_update", "key int, name string", "select n_nationkey as key, 'renamed' as name from nation where n_nationkey = 4")
def _entity_update(e: Engine) -> list[tuple]:
    r = Repository(e, Nation)
    assert r.update(400, {"name": "x"}) is None
    return [tuple(r.update(4, {"name": "renamed"}, projection="key,name").values())]


@_objects("entity_update_many", "changed int, named long", "select 5 as changed, (select count(*) from nation where n_regionkey = 3) as named")
def _entity_update_many(e: Engine) -> list[tuple]:
    r = Repository(e, Nation)
    return [(r.update_many({"name": "many"}, {"region.name": "EUROPE"}), r.count({"name": "many"}))]


@_objects("entity_delete_many", "deleted int, remaining long, exists boolean", "select 5 as deleted, (select count(*) from nation) - 5 as remaining, false as exists")
def _entity_delete_many(e: Engine) -> list[tuple]:
    r = Repository(e, Nation)
    return [(r.delete_many({"regionKey": 4}), r.count(), r.exists_one({"regionKey": 4}))]


@_objects("entity_find_by_id", "key int, name string, region string", "select n_nationkey as key, n_name as name, r_name as region from nation join region on r_regionkey = n_regionkey where n_nationkey in (2, 9)")
def _entity_find_by_id(e: Engine) -> list[tuple]:
    r = Repository(e, Nation)
    assert r.find_by_id(1000) is None
    found = [r.find_by_id(2, projection="key,name,region.name"), r.find_one(projection="key,name,region.name", filter={"key": 9})]
    return [(o["key"], o["name"], o["region"]["name"]) for o in found]


@_objects("entity_objects", "key long, segment string, nation string, orders int", "select c_custkey as key, c_mktsegment as segment, n_name as nation, cast((select count(*) from orders where o_custkey = c_custkey) as integer) as orders from customer join nation on n_nationkey = c_nationkey where n_name = 'NATION_3'")
def _entity_objects(e: Engine) -> list[tuple]:
    found = Repository(e, Customer).find_many(projection="key,account.segment,nation.name,orders.key", filter={"nation.name": "NATION_3"})
    return [(o["key"], o["account"]["segment"], o["nation"]["name"], len(o.get("orders", []))) for o in found]


@_objects("migration", "id int, name string, version int, done boolean", "select 1 as id, 'one' as name, 2 as version, true as done union all select 2, 'two', 2, true")
def _migration(e: Engine) -> list[tuple]:
    """Two versions, the second after a restart; the script's variable is replaced."""
    kinds = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    steps = [
        {"version": 2, "tasks": [{"table": "items", "rows": [{"id": 2, "name": "two"}], "title": "rows"}]},
        {"version": 1, "tasks": [{"fn": lambda engine, migrator: engine.catalog.create("items", kinds), "title": "make"}, {"script": "create or replace temp view lathework_word as select '$(word)' as w"}, {"table": "items", "rows": [{"id": 1, "name": "one"}]}]},
    ]
    Migrator(e, load("catalogue", steps), {"word": "hello"}).execute(1)
    again = Migrator(e, load("catalogue", steps), {"word": "hello"})
    again.execute()
    done = e.spark.table("lathework_word").first()[0] == "hello"
    return [(r["id"], r["name"], again.version, done) for r in e.execute(Select("id", "name").from_("items")).rows]


@_objects("text_dialects", "dialect string, paged string", """select 'postgres' as dialect, 'limit offset' as paged union all select 'sqlite', 'limit offset'
  union all select 'oracle', 'rownum' union all select 'oracle 12', 'fetch offset' union all select 'mssql', 'fetch offset'""")
def _text_dialects(e: Engine) -> list[tuple]:
    """What each dialect's text pages with."""
    q = lambda: Select("c_custkey").from_("customer").order_by("c_custkey").offset(10).limit(20)
    found = []
    for dialect, version in (("postgres", None), ("sqlite", None), ("oracle", "11"), ("oracle", "12"), ("mssql", None)):
        text = q().generate(dialect, dialect_version=version).sql.lower()
        words = [w for w in ("rownum", "limit", "fetch", "offset") if w in text]
        found.append((dialect + (" 12" if version == "12" else ""), "rownum" if "rownum" in words else " ".join(words)))
    return found


@entity()
class Place:
    city = column(str)


@entity("members")
class Member:
    id = primary_key(int, auto_generated=True)
    color = column(str, enum=["red", "blue"], default=lambda values: "red")
    home = embedded(Place, prefix="home_")
    code = column(str, parse=lambda v, n: v.lower(), serialize=lambda v, n: v and v.upper())
    fixed = column(int, no_update=True, default=1)
    teams = column(list)
    joined = link(exclusive=True).to_many("Team", "teams", "name")


@entity("teams", primary=["name", "year"])
class Team:
    name = column(str)
    year = column(int)


def _members(e: Engine) -> Repository:
    e.catalog.create("members", meta_of(Member).schema_type())
    r = Repository(e, Member)
    r.create_only({"code": "aB", "home": {"city": "x"}, "teams": ["t", "u"]})
    r.create_only({"code": "cD", "color": "blue", "teams": ["u"]})
    return r


def _fails(f: Callable[[], Any]) -> bool:
    try:
        f()
    except ValueError:
        return True
    return False


@_objects("entity_values", "id int, code string, stored string, color string, fixed int, city string", "select 1 as id, 'ab' as code, 'AB' as stored, 'red' as color, 1 as fixed, 'y' as city union all select 2, 'cd', 'CD', 'blue', 1, null")
def _entity_values(e: Engine) -> list[tuple]:
    """Generated keys, defaults, enums, parse and serialize, columns that are never updated, embedded parts."""
    r = _members(e)
    r.update_only(1, {"fixed": 9, "home": {"city": "y"}})
    stored = {row["id"]: row["code"] for row in e.execute(Select("id", "code").from_("members")).rows}
    return [(o["id"], o["code"], stored[o["id"]], o["color"], o["fixed"], o.get("home", {}).get("city")) for o in r.find_many(sort="id")]


@_objects("entity_refusals", "enum boolean, circular boolean, key boolean, eager boolean", "select true as enum, true as circular, true as key, true as eager")
def _entity_refusals(e: Engine) -> list[tuple]:
    return [(
        _fails(lambda: _members(e).create({"color": "green"})), _fails(lambda: Repository(e, Region).find_many("nations.region")),
        _fails(lambda: Repository(e, Team).find_by_id({"name": "t"})), _fails(lambda: Repository(e, Region).find_many("nations", max_eager_fetch=2)),
    )]


@_objects("entity_array_keys", "id int, team string, year int", "select 1 as id, 't' as team, 2020 as year union all select 1, 'u', 2021 union all select 1, 'u', 2022 union all select 2, 'u', 2021 union all select 2, 'u', 2022")
def _entity_array_keys(e: Engine) -> list[tuple]:
    """A link whose key is an array takes the rows of each of its elements; composite keys find one row."""
    r = _members(e)
    e.catalog.register("teams", e.spark.createDataFrame([("t", 2020), ("u", 2021), ("u", 2022), ("v", 2023)], "name string, year int"))
    assert Repository(e, Team).find_by_id({"NAME": "u", "year": 2022}) == {"name": "u", "year": 2022}
    return [(o["id"], t["name"], t["year"]) for o in r.find_many("id,joined") for t in o["joined"]]


@_objects("entity_joined_once", "joins int, regions int", "select 2 as joins, 5 as regions")
def _entity_joined_once(e: Engine) -> list[tuple]:
    """A link that projection and order both go along is joined once."""
    df = Repository(e, Customer).dataframe("key,nation.name,nation.region.name", sort=["nation.name", "nation.region.name"])
    plan = df._jdf.queryExecution().analyzed().toString()
    return [(plan.count("Join LeftOuter"), df.select("_row.nation.region.name").distinct().count())]


@_objects("entity_metadata", "names string, writable string, key string, mixed string", "select 'id,color,home,code,fixed,teams,joined' as names, 'id,color,code,teams' as writable, 'name,year' as key, 'id,code,city' as mixed")
def _entity_metadata(e: Engine) -> list[tuple]:
    mixed = meta_of(union(pick(Member, ["id", "code"]), Place)).names()
    return [(",".join(meta_of(Member).names()), ",".join(n for n in meta_of(Member).update_names() if n != "home"), ",".join(c.name for c in meta_of(Team).key), ",".join(mixed))]


@_objects("json_stream", "text string", """select '[' || string_agg('{"r_regionkey": ' || r_regionkey || ', "r_name": "' || r_name || '"}', ',' order by r_regionkey) || ']' as text from region""")
def _json_stream(e: Engine) -> list[tuple]:
    return [("".join(e.execute(Select("r_regionkey", "r_name").from_("region").order_by("r_regionkey"), cursor=True).cursor.to_stream()),)]


@_objects("hooks", "events string, comment string, fetched int", "select 'execute,execute,start-transaction,execute,rollback' as events, '/* by hand */' as comment, 5 as fetched")
def _hooks(e: Engine) -> list[tuple]:
    """Events of the engine and of a query, a comment for one dialect, and a write that opens a transaction."""
    seen, fetched = [], []
    for name in ("execute", "start-transaction", "rollback", "commit"):
        e.on(name, lambda *a, name=name: seen.append(name))
    q = Select("r_name").from_("region").comment("by hand", ["postgres"])
    q.on("fetch", lambda row, info: fetched.append(row["r_name"]))
    e.execute(q)
    e.execute(Insert("region", {"r_regionkey": 9}), auto_commit=False)
    before = e.execute(Select(Count().as_("n")).from_("region")).rows[0]["n"]
    e.rollback()
    assert before == 6
    text = q.generate("postgres").sql
    assert "by hand" not in q.generate("oracle").sql
    return [(",".join(seen), "/* by hand */" if "by hand" in text else text, len(fetched))]


@_objects("memory_tables", "k int, v string", "select 2 as k, 'b' as v union all select 3, 'c'")
def _memory_tables(e: Engine) -> list[tuple]:
    own = connect(e.spark, driver="memory", tables={"t": ([(1, "a"), (2, "b"), (3, "c")], "k int, v string")})
    return [tuple(r) for r in own.execute(Select().from_("t").where({"k >": 1}), object_rows=False).rows]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one region's nations with their orders nested, through entity links."""
    return Repository(_engine(spark, sf_dir), Customer).dataframe(projection="key,name,account,nation.name,orders.(key,total)", filter={"nation.region.name": "ASIA"}, sort=["key", "-orders.total"])


QUERIES["flagship"] = lambda spark, sf_dir: flagship(spark, sf_dir).select("_row.key", "_row.name", F.col("_row.nation.name").alias("nation"), F.explode_outer("_m0").alias("o")).select(
    "key", "name", "nation", F.col("o._row.key").alias("order_key"), F.col("o._row.total").alias("total")
)
ORACLE["flagship"] = (
    "select c_custkey as key, c_name as name, n_name as nation, o_orderkey as order_key, o_totalprice as total from customer left join nation on n_nationkey = c_nationkey "
    "left join orders on o_custkey = c_custkey where c_nationkey in (select n_nationkey from nation join region on r_regionkey = n_regionkey where r_name = 'ASIA')"
)
