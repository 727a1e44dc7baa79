"""Query objects to DataFrames: one declarative plan, which Catalyst then optimises.

Names resolve in scopes: the tables of the query at hand first, then those of the queries around it, as
outer references. Null, list and array rules are applied here, before Spark sees the condition.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elements, predicates, queries
from ..operators.base import Node
from ..operators.types import spark_type

_JOINS = {"inner": "inner", "left": "left", "left outer": "left", "right": "right", "right outer": "right", "outer": "full", "full outer": "full", "cross": "cross"}
_AGGREGATES = (elements.Count, elements.Max, elements.Min, elements.StringAgg)


class QueryError(ValueError):
    """A query that has no plan."""


class OuterRaw(QueryError):
    """Raw text in a sub-query that names a table of a query around it."""


class Scope:
    """The named tables of one query; ``parent`` is the scope of the query around it."""

    def __init__(self, parent: Scope | None = None):
        self.parent = parent
        self.tables: dict[str, set[str]] = {}

    def add(self, alias: str, df: DataFrame) -> None:
        if alias.lower() in self.tables:
            raise QueryError(f"two tables are named {alias}")
        self.tables[alias.lower()] = {c.lower() for c in df.columns}

    def has(self, table: str | None, name: str) -> bool:
        if table:
            return table.lower() in self.tables
        return any(name.lower() in columns for columns in self.tables.values())

    def column(self, table: str | None, name: str) -> Column:
        own = F.col(f"`{table}`.`{name}`" if table else f"`{name}`")
        if self.has(table, name):
            return own
        scope, depth = self.parent, 1
        while scope is not None:
            if scope.has(table, name):
                if depth > 1:
                    raise QueryError(f"{name}: a sub-query can refer to the query right around it only")
                return own.outer()
            scope, depth = scope.parent, depth + 1
        return own


def raw_column(text: str, scope: Scope) -> Column:
    """Raw text as a column; only SQL text can resolve names of outer tables in it."""
    for word in set(re.findall(r"\b([A-Za-z_]\w*)\s*\.", text)):
        outer = scope.parent
        while outer is not None and not scope.has(word, ""):
            if outer.has(word, ""):
                raise OuterRaw(f"{text!r} names {word}")
            outer = outer.parent
    return F.expr(text)


def literal(x: Any) -> Column:
    """A value as a column: aware times are instants, naive ones have no zone, mappings are JSON text."""
    if isinstance(x, dt.datetime) and x.tzinfo is None:
        return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(x, Mapping):
        return F.lit(json.dumps(x, default=str, separators=(",", ":")))
    if isinstance(x, (list, tuple, set, frozenset)):
        return F.array(*[literal(v) for v in x])
    return F.lit(x)


class Compiler:
    """Compiles against ``tables(schema, name) -> DataFrame``; ``params`` bind by name."""

    def __init__(
        self, spark: SparkSession, tables: Callable[[str | None, str], DataFrame], params: Mapping[str, Any] | None = None, counter: Callable[[str, int], int] | None = None,
        staged: Callable[[DataFrame, str], DataFrame] | None = None,
    ):
        self.spark, self.tables, self.params, self.counter, self.staged = spark, tables, dict(params or {}), counter, staged
        self._numbers: dict[str, list[Any]] = {}  # sequences of the rows at hand: [value before the row, next calls so far]

    # -- queries

    def query(self, q: Node, outer: Scope | None = None) -> DataFrame:
        if isinstance(q, queries.Query) and q.params:
            self.params |= q.params
        if isinstance(q, queries.Union):
            parts = [self.query(x, outer) for x in q.queries]
            if not parts:
                raise QueryError("a union needs a query")
            df = reduce(DataFrame.union, parts)
            return df if q.all else df.distinct()
        if isinstance(q, queries.Select):
            return self._select(q, outer)
        if isinstance(q, elements.Raw):
            return self.spark.sql(q.text)
        raise QueryError(f"{type(q).__name__} gives no rows")

    def source(self, t: Node, outer: Scope | None = None) -> tuple[str, DataFrame]:
        """(alias, DataFrame) of what stands in FROM or JOIN."""
        if isinstance(t, elements.Table):
            df = self.tables(t.schema, t.name)
            for dialect, hint in t.hints:
                if dialect in (None, "spark"):
                    name, _, args = hint.partition("(")
                    df = df.hint(name.strip(), *[a.strip() for a in args.rstrip(") ").split(",") if a.strip()])
            alias = t.alias or t.name
        elif isinstance(t, queries.Query):
            if not t.alias:
                raise QueryError("Alias required for sub-select")
            df, alias = self.query(t, outer), t.alias
        elif isinstance(t, elements.Raw):
            df = self.spark.sql(f"select * from {t.text}")
            words = t.text.replace(")", ") ").split()
            alias = words[-1] if len(words) > 1 and words[-1].isidentifier() else f"raw_{abs(hash(t.text)) % 10**8}"
        else:
            raise QueryError(f"{type(t).__name__} is no table")
        return alias, df.alias(alias)

    def _select(self, q: queries.Select, outer: Scope | None) -> DataFrame:
        scope = Scope(outer)
        df: DataFrame | None = None
        for t in q.tables:
            alias, other = self.source(t, outer)
            scope.add(alias, other)
            df = other if df is None else df.crossJoin(other)
        if df is None:
            df = self.spark.range(1).select()
        for j in q.joins:
            df = self._join(df, j, scope, outer)
        if q.condition and (where := self.condition(q.condition, scope)) is not None:
            df = df.where(where)
        if q.tables and not q.groups and not q.unique and (calls := _next_calls(q.columns)) and not any(_aggregates(c) for c in q.columns):
            return self._numbered(q, df, scope, calls)
        chosen = self._chosen(q, scope, df)
        if q.groups or any(_aggregates(c) for c in q.columns):
            df = self._grouped(q, df, scope, chosen)
        else:
            df = self._plain(q, df, scope, chosen)
        if q.skipped and q.skipped > 0:
            df = df.offset(q.skipped)
        return df.limit(q.limited) if q.limited else df

    def _chosen(self, q: queries.Select, scope: Scope, df: DataFrame) -> list[tuple[str | None, Column]]:
        chosen = [self._output(c, scope, df) for c in q.columns] or [("*", F.col("*"))]
        return [c for c in chosen if c is not None]

    def _numbered(self, q: queries.Select, df: DataFrame, scope: Scope, calls: dict[str, int]) -> DataFrame:
        """A select whose sequences advance row by row.

        The rows, ordered and cut as asked, are written with their partition and place in it; the number of rows
        of each partition (one small row each) gives every row its rank without a single-task sort.
        """
        if self.counter is None or self.staged is None:
            raise QueryError("sequences need an engine")
        if q.order:
            df = df.orderBy(*[self._sort(o, scope, {}) for o in q.order])
        if q.skipped and q.skipped > 0:
            df = df.offset(q.skipped)
        df = df.limit(q.limited) if q.limited else df
        sources = [(alias, sorted(columns)) for alias, columns in scope.tables.items()]
        kept = self.staged(df.select(*[F.struct(F.col(f"`{alias}`.*")).alias(f"t{i}") for i, (alias, _) in enumerate(sources)], F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "sequence")
        sizes = sorted(kept.groupBy("_part").count().collect())
        before, total = {}, 0
        for part, n in sizes:
            before[part], total = total, total + n
        firsts = F.create_map(*[F.lit(x) for part, n in before.items() for x in (part, n)]) if before else F.create_map().cast("map<int,bigint>")
        rank = (F.element_at(firsts, F.col("_part")) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
        rows = kept.withColumn("_rank", rank)
        self._numbers = {name: [F.lit(self.counter(name, total * k) - total * k) + F.col("_rank") * k if total else F.lit(None).cast("long"), 0] for name, k in calls.items()}
        every = any(isinstance(c, elements.Field) and c.name == "*" for c in q.columns)
        if len(sources) == 1:
            out = rows.select("t0.*", "_rank").alias(sources[0][0])
        elif every:
            raise QueryError("name the columns beside a sequence that numbers joined rows")
        else:  # one row has all tables: each becomes a struct column of its alias, whose fields resolve as before
            names = [c for _, columns in sources for c in columns]
            single = [F.col(f"t{i}.`{c}`").alias(c) for i, (_, columns) in enumerate(sources) for c in columns if names.count(c) == 1 and c not in scope.tables]
            out = rows.select(*[F.col(f"t{i}").alias(alias) for i, (alias, _) in enumerate(sources)], *single, "_rank")
        try:
            out = out.orderBy("_rank") if q.order else out
            out = out.select(*self._named(self._chosen(q, scope, out)))
            return out.drop("_rank") if every else out
        finally:
            self._numbers = {}

    def _join(self, df: DataFrame, j: elements.Join, scope: Scope, outer: Scope | None) -> DataFrame:
        alias, other = self.source(j.table, outer)
        scope.add(alias, other)
        on = self.condition(j.condition, scope) if j.condition is not None else None
        how = _JOINS[j.how]
        if on is None:
            return df.crossJoin(other) if how in ("inner", "cross") else df.join(other, F.lit(True), how)
        return df.join(other, on, "inner" if how == "cross" else how)

    def _output(self, c: Node, scope: Scope, df: DataFrame) -> tuple[str | None, Column] | None:
        """(name, column) of a select item; the name is None where Spark is to choose."""
        if isinstance(c, elements.Field):
            if c.name == "*":
                return "*", F.col(f"`{c.table}`.*" if c.table else "*")
            return c.alias or c.name, self.expression(c, scope)
        if isinstance(c, queries.Query):
            if not c.alias:
                raise QueryError("Alias required for sub-select in columns")
            return c.alias, self.query(c, scope).scalar()
        if isinstance(c, elements.Case) and not c.branches:
            return None
        if isinstance(c, elements.Call) and not isinstance(c, elements.Coalesce) and any(a is None or a == "" for a in c.args if not isinstance(a, Node)):
            return None
        return getattr(c, "alias", None), self.expression(c, scope)

    @staticmethod
    def _named(chosen: list[tuple[str | None, Column]]) -> list[Column]:
        return [c if n in (None, "*") else c.alias(n) for n, c in chosen]

    def _sort(self, o: Node, scope: Scope, named: Mapping[str, Column]) -> Column:
        if isinstance(o, elements.OrderColumn):
            key = named.get(o.name.lower()) if not o.table else None
            column = self.expression(elements.Field(f"{o.table}.{o.name}" if o.table else o.name), scope) if key is None else key
            return column.desc_nulls_first() if o.descending else column.asc_nulls_last()
        return self.expression(o, scope)

    def _plain(self, q: queries.Select, df: DataFrame, scope: Scope, chosen: list[tuple[str | None, Column]]) -> DataFrame:
        named = {n.lower(): c for n, c in chosen if n and n != "*"}
        if q.unique:
            df = df.select(*self._named(chosen)).distinct()
            return df.orderBy(*[self._sort(o, Scope(), {}) if not isinstance(o, elements.OrderColumn) else self._sort(elements.OrderColumn(("-" if o.descending else "") + o.name), Scope(), {}) for o in q.order]) if q.order else df
        if q.order:
            df = df.orderBy(*[self._sort(o, scope, named) for o in q.order])
        return df.select(*self._named(chosen))

    def _grouped(self, q: queries.Select, df: DataFrame, scope: Scope, chosen: list[tuple[str | None, Column]]) -> DataFrame:
        if not q.groups:  # one row, whose order is of no concern
            df = df.select(*self._named(chosen))
            return df.distinct() if q.unique else df
        keys = [self.expression(g, scope) for g in q.groups]
        named = {n.lower(): F.col(f"_o{i}") for i, (n, _) in enumerate(chosen) if n}
        hidden: list[Column] = []
        order: list[Column] = []
        for o in q.order:
            if isinstance(o, elements.OrderColumn):
                column = named.get(o.name.lower()) if not o.table else None
                if column is None:
                    hidden.append(self.expression(elements.Field(f"{o.table}.{o.name}" if o.table else o.name), scope))
                    column = F.col(f"_h{len(hidden) - 1}")
                order.append(column.desc_nulls_first() if o.descending else column.asc_nulls_last())
            else:
                order.append(self.expression(o, scope))
        plain = df.groupBy(*keys).agg(*[c for _, c in chosen], *hidden)
        names = plain.columns[len(keys) : len(keys) + len(chosen)]
        df = plain.toDF(*[f"_k{i}" for i in range(len(keys))], *[f"_o{i}" for i in range(len(chosen))], *[f"_h{i}" for i in range(len(hidden))])
        if order and not q.unique:
            df = df.orderBy(*order)
        df = df.select(*[F.col(f"_o{i}").alias(n or names[i]) for i, (n, _) in enumerate(chosen)])
        if q.unique:
            df = df.distinct()
            if q.order:
                df = df.orderBy(*[self._sort(o, Scope(), {}) for o in q.order])
        return df

    # -- expressions

    def expression(self, x: Any, scope: Scope) -> Column:
        if not isinstance(x, Node):
            return literal(x)
        if isinstance(x, (elements.Field, elements.GroupColumn)):
            return scope.column(x.table, x.name)
        if isinstance(x, elements.OrderColumn):
            return self._sort(x, scope, {})
        if isinstance(x, elements.Raw):
            return raw_column(x.text, scope)
        if isinstance(x, elements.Param):
            value = literal(self.value(x))
            return value.cast(spark_type(x.data_type, x.is_array)) if x.data_type else value
        if isinstance(x, elements.Case):
            out: Column | None = None
            for condition, then in x.branches:
                when = self.condition(condition, scope)
                when = F.lit(True) if when is None else when
                out = F.when(when, self.expression(then, scope)) if out is None else out.when(when, self.expression(then, scope))
            if out is None:
                return F.lit(None)
            return out.otherwise(self.expression(x.otherwise, scope)) if x.has_otherwise else out
        if isinstance(x, elements.Count):
            return F.count(F.lit(1))
        if isinstance(x, elements.StringAgg):
            return self._string_agg(x, scope)
        if isinstance(x, elements.Call):
            return getattr(F, x.function)(*[self.expression(a, scope) for a in x.args])
        if isinstance(x, elements.Sequence):
            if self.counter is None:
                raise QueryError("sequences need an engine")
            if x.name in self._numbers:
                state = self._numbers[x.name]
                state[1] += bool(x.advance)
                return state[0] + F.lit(state[1])
            return F.lit(self.counter(x.name, int(bool(x.advance))))
        if isinstance(x, queries.Query):
            return self.query(x, scope).scalar()
        if isinstance(x, predicates.Condition):
            found = self.condition(x, scope)
            return F.lit(True) if found is None else found
        raise QueryError(f"{type(x).__name__} is no expression")

    def _string_agg(self, x: elements.StringAgg, scope: Scope) -> Column:
        text = self.expression(x.field, scope)
        if not x.order:
            return F.listagg(text, F.lit(x.separator))
        # in order: sorted structs of the keys, nulls last when ascending, then the texts alone
        fields, signs = [], []
        texts = text.cast("string").alias("t")
        for i, o in enumerate(x.order):
            descending = isinstance(o, elements.OrderColumn) and o.descending
            key = scope.column(o.table, o.name) if isinstance(o, elements.OrderColumn) else self.expression(o, scope)
            fields += [key.isNull().alias(f"n{i}"), key.alias(f"k{i}")]
            signs.append(-1 if descending else 1)
        rows = F.collect_list(F.when(text.isNotNull(), F.struct(*fields, texts)))
        joined = F.array_join(F.transform(in_order(rows, signs), lambda r: r["t"]), x.separator)
        return F.when(F.size(rows) > 0, joined)

    # -- conditions

    def value(self, x: Any) -> Any:
        """A parameter's value; Raw('null') and missing parameters are None."""
        if isinstance(x, elements.Param):
            value = self.params.get(x.name)
            if x.is_array and value is not None and not isinstance(value, (list, tuple, set, frozenset)):
                return [value]
            return value
        if isinstance(x, elements.Raw) and x.text.strip().lower() == "null":
            return None
        return x

    def condition(self, c: Node, scope: Scope) -> Column | None:
        """The condition as a column, or None where it vanishes."""
        if isinstance(c, elements.Raw):
            return raw_column(c.text, scope)
        if isinstance(c, predicates.Logical):
            parts = [p for p in (self.condition(i, scope) for i in c.items) if p is not None]
            if not parts:
                return None
            return reduce(Column.__and__ if c.word == "and" else Column.__or__, parts)
        if isinstance(c, predicates.Not):
            inner = self.condition(c.condition, scope)
            return None if inner is None else ~inner
        if isinstance(c, predicates.Exists):
            found = self.query(c.query, scope).exists()
            return ~found if c.negated else found
        if isinstance(c, predicates.Comparison):
            return self._comparison(c, scope)
        raise QueryError(f"{type(c).__name__} is no condition")

    def _comparison(self, c: predicates.Comparison, scope: Scope) -> Column | None:
        if c.empty:
            return None
        left = self.expression(c.left, scope)
        array = isinstance(c.left, elements.Field) and c.left.is_array
        right, op = self.value(c.right), c.operator
        if op in ("between", "not_between"):
            low, high = (self.expression(self.value(b), scope) for b in right)
            return left.between(low, high) if op == "between" else ~left.between(low, high)
        if op in ("in", "not_in", "eq", "ne") and isinstance(right, (list, tuple, set, frozenset)):
            return self._membership(left, array, list(right), op in ("not_in", "ne"), scope)
        if op in ("in", "not_in"):
            if isinstance(right, queries.Query):
                found = left.isin(self.query(right, scope))
            elif array:
                found = F.array_contains(left, self.expression(right, scope))
            else:
                found = left == self.expression(right, scope)
            return ~found if op == "not_in" else found
        if right is None and op in ("eq", "is"):
            return left.isNull()
        if right is None and op in ("ne", "is_not"):
            return left.isNotNull()
        other = self.expression(c.right if isinstance(c.right, elements.Param) else right, scope)
        return {
            "eq": lambda: left == other, "ne": lambda: left != other, "gt": lambda: left > other, "gte": lambda: left >= other, "lt": lambda: left < other, "lte": lambda: left <= other,
            "is": lambda: left.eqNullSafe(other), "is_not": lambda: ~left.eqNullSafe(other),
            "like": lambda: F.like(left, other), "not_like": lambda: ~F.like(left, other), "ilike": lambda: F.ilike(left, other), "not_ilike": lambda: ~F.ilike(left, other),
        }[op]()

    def _membership(self, left: Column, array: bool, values: list[Any], negated: bool, scope: Scope) -> Column | None:
        if not values:
            return None
        if array:
            found = F.arrays_overlap(left, F.array(*[self.expression(v, scope) for v in values]))
        else:
            found = left.isin(*[self.expression(v, scope) for v in values])
        return ~found if negated else found


def in_order(rows: Column, signs: list[int]) -> Column:
    """Structs (n0, k0, n1, k1, ..., more) by their keys; n says that the key is null: last ascending, first descending.

    One direction for all keys is the structs' own order. Mixed ones need a comparison.
    """
    if len(set(signs)) == 1:
        return F.sort_array(rows, signs[0] > 0)

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(len(signs))):
            less = (~a[f"n{i}"] & b[f"n{i}"]) | (a[f"k{i}"] < b[f"k{i}"])
            more = (a[f"n{i}"] & ~b[f"n{i}"]) | (a[f"k{i}"] > b[f"k{i}"])
            out = F.when(less, F.lit(-signs[i])).when(more, F.lit(signs[i])).otherwise(out)
        return out

    return F.array_sort(rows, compare)


def _next_calls(x: Any) -> dict[str, int]:
    """How often each sequence advances in select items (sub-selects apart)."""
    out: dict[str, int] = {}
    if isinstance(x, elements.Sequence):
        return {x.name: 1} if x.advance else {}
    if isinstance(x, (list, tuple)):
        inner = list(x)
    else:
        inner = [v for k, v in vars(x).items() if k != "listeners"] if isinstance(x, Node) and not isinstance(x, queries.Query) else []
    for v in inner:
        for name, n in _next_calls(v).items():
            out[name] = out.get(name, 0) + n
    return out


def with_tables(query: Node, names: Mapping[str, str]) -> Node:
    """A copy of the query whose tables have other names; their old ones stay as aliases."""
    out = copy.deepcopy(query)

    def walk(x: Any) -> None:
        if isinstance(x, elements.Table):
            if x.name in names:
                x.alias, x.name, x.schema = x.alias or x.name, names[x.name], None
        elif isinstance(x, Node):
            for k, v in vars(x).items():
                if k != "listeners":
                    walk(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                walk(v)

    walk(out)
    return out


def tables_of(x: Any) -> set[str]:
    """Names of the tables anywhere in a query."""
    if isinstance(x, elements.Table):
        return {x.name}
    if isinstance(x, Node):
        return set().union(*[tables_of(v) for k, v in vars(x).items() if k != "listeners"], set())
    if isinstance(x, (list, tuple)):
        return set().union(*[tables_of(v) for v in x], set())
    return set()


def has_raw(x: Any, depth: int = 0) -> bool:
    """Whether raw text stands in a query within a query, where it may name the outer one's tables."""
    if isinstance(x, elements.Raw):
        return depth > 1
    if isinstance(x, Node):
        inner = depth + isinstance(x, queries.Query)
        return any(has_raw(v, inner) for k, v in vars(x).items() if k != "listeners")
    return isinstance(x, (list, tuple)) and any(has_raw(v, depth) for v in x)


def _aggregates(x: Any) -> bool:
    """Whether an aggregate stands in an expression (not in a sub-select of it)."""
    if isinstance(x, _AGGREGATES):
        return True
    if isinstance(x, elements.Call):
        return any(_aggregates(a) for a in x.args)
    if isinstance(x, elements.Case):
        return any(_aggregates(v) for _, v in x.branches) or _aggregates(x.otherwise)
    return False
