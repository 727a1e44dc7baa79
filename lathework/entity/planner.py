"""Reading entities as one plan.

Columns are pruned by the projection. To-one links become left joins with the link's conditions in ON;
to-many links become grouped lists that are joined by key, so there is no query per row. Filters along
links become EXISTS, which never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import elements, predicates, queries
from ..operators.base import Node
from ..plans import Compiler, Scope
from ..plans.compiler import in_order
from .model import Column, Embedded, Hop, Link, Meta, ModelError, keys_of, meta_of
from .projection import Item, wanted

#: How deep lists nest unless asked otherwise.
MAX_SUB_QUERIES = 5


@dataclass
class Shape:
    """How a result's struct turns into an object: each name's column, its parser or its own shape."""

    fields: list[tuple[str, Any]] = field(default_factory=list)


class Planner:
    def __init__(self, compiler: Compiler, max_sub_queries: int = MAX_SUB_QUERIES, most_linked: int | None = None):
        """``most_linked`` cuts every list one item beyond it, so that the reader can tell and no list grows without bound."""
        self.compiler, self.max_sub_queries, self.most_linked = compiler, max_sub_queries, most_linked
        self._aliases = 0

    def alias(self) -> str:
        self._aliases += 1
        return f"J{self._aliases}"

    def table(self, meta: Meta, alias: str, hint: Any = None) -> elements.Table:
        t = elements.Table(f"{meta.table} {alias}", hint)
        t.schema = meta.schema or t.schema
        return t

    # -- filters

    def filter(self, meta: Meta, alias: str, condition: Any) -> predicates.And:
        """The condition with property paths resolved to columns of ``alias`` or to EXISTS."""
        return predicates.And(*[self._resolved(meta, alias, c) for c in predicates.as_conditions([condition])])

    def _resolved(self, meta: Meta, alias: str, c: Node) -> Node:
        if isinstance(c, predicates.Logical):
            out = type(c)()
            out.items = [self._resolved(meta, alias, i) for i in c.items]
            return out
        if isinstance(c, predicates.Not):
            out = copy(c)
            out.condition = self._resolved(meta, alias, c.condition)
            return out
        if not isinstance(c, predicates.Comparison) or not isinstance(c.left, (elements.Field, predicates.Path)):
            return c
        left = c.left
        parts = left.parts if isinstance(left, predicates.Path) else [p for p in (left.schema, left.table, left.name) if p]
        return self._at(meta, alias, parts, c)

    def _at(self, meta: Meta, alias: str, parts: list[str], c: predicates.Comparison) -> Node:
        prefix = suffix = ""
        for i, part in enumerate(parts):
            f = meta.field(part)
            rest = parts[i + 1 :]
            if isinstance(f, Embedded) and rest:
                prefix, suffix, meta = prefix + f.prefix, f.suffix + suffix, meta_of(f.type)
            elif isinstance(f, Link) and rest:
                return self._exists(meta, alias, f, rest, c, prefix, suffix)
            elif isinstance(f, Column) and not rest:
                out = copy(c)
                out.left = elements.Field(f"{alias}.{prefix}{f.field_name or f.name}{suffix}", f.data_type, f.is_array or c.left.is_array)
                return out
            else:
                break
        raise ModelError(f"{'.'.join(parts)} is no column of {meta.name}")

    def _exists(self, meta: Meta, alias: str, link: Link, rest: list[str], c: predicates.Comparison, prefix: str, suffix: str) -> Node:
        """EXISTS over the first hop; further hops nest inside, each tied to the one before."""

        def step(source: Meta, outer: str, hops: list[Hop], prefix: str, suffix: str) -> Node:
            if not hops:
                return self._at(source, outer, rest, c)
            hop, inner, target = hops[0], self.alias(), meta_of(hops[0].target)
            a, b = keys_of(source, hop)
            sub = queries.Select(elements.Raw("1")).from_(self.table(target, inner))
            sub.where(predicates.Eq(elements.Field(f"{inner}.{b.field_name or b.name}"), elements.Field(f"{outer}.{prefix}{a.field_name or a.name}{suffix}")))
            if hop.where is not None:
                sub.where(self.filter(target, inner, hop.where))
            sub.where(step(target, inner, hops[1:], "", ""))
            return predicates.Exists(sub)

        return step(meta, alias, link.hops, prefix, suffix)

    # -- reads

    def read(
        self, meta: Meta, tree: dict[str, Item], filter_: Any = None, sort: list[str] | None = None, offset: int | None = None, limit: int | None = None, distinct: bool = False, hint: Any = None, path: tuple[Meta, ...] = (), key: Column | None = None, depth: int = 0,
        among: DataFrame | None = None,
    ) -> tuple[DataFrame, Shape]:
        """``(_row struct, [_key])`` of the entities, and how the struct reads. ``key`` asks for the grouping key.

        ``among`` has the keys ``_k`` that are wanted, where not all are.
        """
        if meta in path:
            raise ModelError("Circular fields requested")
        scope = Scope()
        _, df = self.compiler.source(self.table(meta, "T", hint))
        scope.add("T", df)
        joins: dict[tuple[str, int], str] = {}
        state = _State(df, scope, joins)
        if filter_ is not None and (where := self.compiler.condition(self.filter(meta, "T", filter_), scope)) is not None:
            state.df = state.df.where(where)
        if among is not None:
            state.df = state.df.join(among, F.col(f"`T`.`{key.field_name or key.name}`") == F.col("_k"), "left_semi")
        tops = [s for s in sort or [] if not self._below_many(meta, s)]
        order = [self._sort(meta, s, state) for s in tops]
        shape = Shape()
        lists: list[tuple[Link, Meta, Item, str, str, Shape, str]] = []
        row = self._struct(meta, "T", tree, state, shape, lists, "", "", (*path, meta), depth, ())
        keyed = [F.col(f"`T`.`{key.field_name or key.name}`").alias("_key")] if key is not None else []
        keys = [F.col(f"`{alias}`.`{name}`").alias(f"_l{i}") for i, (_, _, _, alias, name, _, _) in enumerate(lists)]
        # a value that sorts like the column: so that the order outlives the joins below
        marks = [c.alias(f"_s{i}") for i, (c, _) in enumerate(order)]
        df = state.df.select(row.alias("_row"), *keyed, *keys, *marks)
        if distinct:
            df = df.distinct()
        ordering = [F.col(f"_s{i}").desc_nulls_first() if down else F.col(f"_s{i}").asc_nulls_last() for i, (_, down) in enumerate(order)]
        if ordering and (offset or limit or not lists):
            df = df.orderBy(*ordering)
        if offset:
            df = df.offset(offset)
        if limit:
            df = df.limit(limit)
        for i, (link, source, item, _, _, own, name) in enumerate(lists):
            below = [s[: len(s) - len(bare)] + bare[len(name) + 1 :] for s in sort or [] if (bare := s.lstrip("+-")).lower().startswith(name + ".")]
            many_keys = df.schema[f"_l{i}"].dataType.typeName() == "array"
            parents: DataFrame | None = None
            if filter_ is not None or offset or limit or among is not None:  # else nearly all children are wanted
                wanted_keys = F.explode(f"_l{i}") if many_keys else F.col(f"_l{i}")
                parents = df.select(wanted_keys.alias("_k")).where("_k is not null").distinct()
            children = self._children(link, source, item, below, own, (*path, meta), depth + 1, parents)
            if many_keys:
                df = self._attach_by_elements(df, children, i)
            else:
                df = df.join(children.select(F.col("_key").alias(f"_c{i}"), F.col("_list").alias(f"_m{i}")), F.col(f"_l{i}") == F.col(f"_c{i}"), "left").drop(f"_c{i}")
        if ordering and lists:
            df = df.orderBy(*ordering)
        found = [F.col("_row"), *[F.col(f"_m{i}") for i in range(len(lists))], *([F.col("_key")] if keyed else []), *[F.col(f"_s{i}") for i in range(len(order))]]
        return df.select(*found), shape

    @staticmethod
    def _attach_by_elements(df: DataFrame, children: DataFrame, i: int) -> DataFrame:
        """Lists of all elements of an array key; rows with equal keys share them."""
        keys = df.select(F.col(f"_l{i}").alias("_a")).distinct()
        each = keys.select("_a", F.explode("_a").alias("_e")).distinct().join(children.select("_key", "_list"), F.col("_e") == F.col("_key"))
        lists = each.groupBy("_a").agg(F.flatten(F.collect_list("_list")).alias(f"_m{i}"))
        return df.join(lists, F.col(f"_l{i}") == F.col("_a"), "left").drop("_a")

    def _below_many(self, meta: Meta, path: str) -> bool:
        for part in path.lstrip("+-").split(".")[:-1]:
            f = meta.field(part)
            if isinstance(f, Link):
                if f.many:
                    return True
                meta = meta_of(f.hops[-1].target)
            elif isinstance(f, Embedded):
                meta = meta_of(f.type)
        return False

    def _sort(self, meta: Meta, text: str, state: _State) -> tuple[C, bool]:
        alias, prefix, suffix = "T", "", ""
        parts = text.lstrip("+-").split(".")
        for i, part in enumerate(parts):
            f = meta.field(part)
            last = i == len(parts) - 1
            if isinstance(f, Column) and last:
                return F.col(f"`{alias}`.`{prefix}{f.field_name or f.name}{suffix}`"), text.startswith("-")
            if isinstance(f, Embedded) and not last:
                prefix, suffix, meta = prefix + f.prefix, f.suffix + suffix, meta_of(f.type)
            elif isinstance(f, Link) and not last:
                alias = self._joined(meta, alias, f, state, prefix, suffix)
                meta, prefix, suffix = meta_of(f.hops[-1].target), "", ""
            else:
                break
        raise ModelError(f"can't sort by {text}")

    def _joined(self, meta: Meta, alias: str, link: Link, state: _State, prefix: str, suffix: str) -> str:
        """The alias of a to-one link's target; a link that is joined already is used again."""
        for n, hop in enumerate(link.hops):
            known = (alias, id(hop))
            if known not in state.joins:
                inner, target = self.alias(), meta_of(hop.target)
                _, other = self.compiler.source(self.table(target, inner))
                state.scope.add(inner, other)
                a, b = keys_of(meta, hop)
                near = f"{prefix}{a.field_name or a.name}{suffix}" if n == 0 else a.field_name or a.name
                on = F.col(f"`{alias}`.`{near}`") == F.col(f"`{inner}`.`{b.field_name or b.name}`")
                if hop.where is not None and (more := self.compiler.condition(self.filter(target, inner, hop.where), state.scope)) is not None:
                    on = on & more
                state.df = state.df.join(other, on, "left")
                state.joins[known] = inner
            alias, meta = state.joins[known], meta_of(hop.target)
        return alias

    def _struct(self, meta: Meta, alias: str, tree: dict[str, Item], state: _State, shape: Shape, lists: list, prefix: str, suffix: str, path: tuple[Meta, ...], depth: int, at: tuple[str, ...]) -> C:
        fields: list[C] = []
        names = [f.name for f in meta.fields.values() if not f.hidden]
        for name in wanted(names, tree, lambda n: meta.field(n).exclusive):
            f, item = meta.field(name), tree.get(name.lower(), Item())
            if isinstance(f, Column):
                fields.append(F.col(f"`{alias}`.`{prefix}{f.field_name or f.name}{suffix}`").alias(name))
                shape.fields.append((name, f))
            elif isinstance(f, Embedded):
                own = Shape()
                inner = self._struct(meta_of(f.type), alias, item.children, state, own, lists, prefix + f.prefix, f.suffix + suffix, path, depth, (*at, name))
                fields.append(inner.alias(name))
                shape.fields.append((name, own))
            elif not f.many:
                target = meta_of(f.hops[-1].target)
                if target in path:
                    raise ModelError("Circular fields requested")
                inner_alias = self._joined(meta, alias, f, state, prefix, suffix)
                source = meta if len(f.hops) == 1 else meta_of(f.hops[-2].target)
                there = F.col(f"`{inner_alias}`.`{(k := keys_of(source, f.hops[-1])[1]).field_name or k.name}`").isNotNull()
                own = Shape()
                inner = self._struct(target, inner_alias, item.children, state, own, lists, "", "", (*path, target), depth, (*at, name))
                fields.append(F.when(there, inner).alias(name))
                shape.fields.append((name, own))
            elif depth < self.max_sub_queries:
                if meta_of(f.hops[-1].target) in path:
                    raise ModelError("Circular fields requested")
                own = Shape()
                key = keys_of(meta, f.hops[0])[0]
                lists.append((f, meta, item, alias, f"{prefix}{key.field_name or key.name}{suffix}", own, ".".join((*at, name)).lower()))
                shape.fields.append((name, ("list", len(lists) - 1, own)))
        return F.struct(*fields) if fields else F.struct(F.lit(1).alias("_one"))

    def _children(self, link: Link, source: Meta, item: Item, sort: list[str], shape: Shape, path: tuple[Meta, ...], depth: int, parents: DataFrame | None) -> DataFrame:
        """``(_key, _list)``: the link's rows by the key that the parent has, in the asked order.

        ``parents`` has the parents' keys ``_k``: rows of others are dropped by a semi-join before they are sorted
        or grouped, hop by hop.
        """
        chain: DataFrame | None = None  # (_in, _out): the parent's key and the key that the last hop's rows refer to
        among = parents
        for n in range(1, len(link.hops)):
            middle = meta_of(link.hops[n - 1].target)
            alias = self.alias()
            _, other = self.compiler.source(self.table(middle, alias))
            scope = Scope()
            scope.add(alias, other)
            if link.hops[n - 1].where is not None and (more := self.compiler.condition(self.filter(middle, alias, link.hops[n - 1].where), scope)) is not None:
                other = other.where(more)
            out_key = keys_of(middle, link.hops[n])[0]
            in_key = keys_of(source if n == 1 else meta_of(link.hops[n - 2].target), link.hops[n - 1])[1]
            other = other.select(F.col(f"`{alias}`.`{in_key.field_name or in_key.name}`").alias("_i"), F.col(f"`{alias}`.`{out_key.field_name or out_key.name}`").alias("_o"))
            if among is not None:
                other = other.join(among, F.col("_i") == F.col("_k"), "left_semi")
            chain = other.toDF("_in", "_out") if chain is None else chain.join(other, F.col("_out") == F.col("_i")).select("_in", F.col("_o").alias("_out"))
            among = chain.select(F.col("_out").alias("_k")).distinct() if among is not None else None
        last = link.hops[-1]
        target = meta_of(last.target)
        back = keys_of(source if len(link.hops) == 1 else meta_of(link.hops[-2].target), last)[1]
        df, own = self.read(target, item.children, last.where, sort, path=path, key=back, depth=depth, among=among)
        shape.fields = own.fields
        nested = [c for c in df.columns if c.startswith("_m")]
        marks = [c for c in df.columns if c.startswith("_s")]
        df = df.select("_key", F.struct(F.col("_row"), *[F.col(m) for m in nested]).alias("_item"), *marks)
        if chain is not None:
            df = df.join(chain, F.col("_key") == F.col("_out")).drop("_key", "_out").withColumnRenamed("_in", "_key")
        df = df.where("_key is not null")
        signs = [-1 if s.startswith("-") else 1 for s in sort if not self._below_many(target, s)]
        if self.most_linked is not None:
            order = [F.col(m).desc_nulls_first() if sign < 0 else F.col(m).asc_nulls_last() for m, sign in zip(marks, signs, strict=True)]
            place = F.row_number().over(Window.partitionBy("_key").orderBy(*(order or [F.col("_key")])))
            df = df.withColumn("_place", place).where(F.col("_place") <= self.most_linked + 1).drop("_place")
        if marks:
            keys = [x for i, m in enumerate(marks) for x in (F.col(m).isNull().alias(f"n{i}"), F.col(m).alias(f"k{i}"))]
            rows = in_order(F.collect_list(F.struct(*keys, "_item")), signs)
        else:
            rows = F.collect_list(F.struct("_item"))
        return df.groupBy("_key").agg(F.transform(rows, lambda r: r["_item"]).alias("_list"))


@dataclass
class _State:
    df: DataFrame
    scope: Scope
    joins: dict[tuple[str, int], str]


def to_object(row: Any, lists: list[Any], shape: Shape, transform: Callable | None = None) -> dict[str, Any] | None:
    """A dict of a row's struct and its lists; nulls and objects without a value are left out."""
    import json

    from ..operators.types import DataType

    if row is None:
        return None
    out: dict[str, Any] = {}
    for name, what in shape.fields:
        if isinstance(what, tuple):
            items = lists[what[1]]
            value = [to_object(i["_row"], [v for k, v in i.asDict().items() if k.startswith("_m")], what[2]) for i in items] if items is not None else None
        elif isinstance(what, Shape):
            value = to_object(row[name], lists, what) or None
        else:
            value = row[name]
            if value is not None and what.data_type is DataType.JSON and isinstance(value, str):
                value = json.loads(value)
            if value is not None and what.parse:
                value = what.parse(value, name)
        if value is not None:
            out[name] = value
    return out
