"""Finding, counting and writing entities."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import elements, predicates, queries
from ..operators.base import Node
from ..operators.types import DataType
from ..sources.engine import Engine
from .model import Column, Embedded, Link, Meta, ModelError, meta_of
from .planner import MAX_SUB_QUERIES, Planner, to_object
from .projection import parse

_NUMBERS = (DataType.SMALLINT, DataType.INTEGER, DataType.BIGINT, DataType.NUMBER, DataType.FLOAT, DataType.DOUBLE)


def key_values(meta: Meta, key: Any) -> dict[str, Any]:
    """``{field: value}`` of a key given as a value (one key column) or a mapping or object with all parts."""
    columns = meta.key
    if not columns:
        raise ModelError(f"{meta.name} has no primary key")
    if not isinstance(key, Mapping) and hasattr(key, "__dict__"):
        key = vars(key)
    if not isinstance(key, Mapping):
        if len(columns) > 1:
            raise ModelError(f"{meta.name} needs all of {', '.join(c.name for c in columns)}")
        return {columns[0].name: key}
    given = {k.lower(): v for k, v in key.items()}
    out = {}
    for c in columns:
        if c.name.lower() not in given:
            raise ModelError(f"the key has no {c.name}")
        out[c.name] = given.pop(c.name.lower())
    for k, v in given.items():  # more properties narrow further
        if meta.column(k):
            out[meta.column(k).name] = v
    return out


class Repository:
    def __init__(self, engine: Engine, entity: Any, schema: str | None = None):
        self.engine, self.meta, self.schema = engine, meta_of(entity), schema

    def _compiler(self, params: Mapping[str, Any] | None = None):
        compiler = self.engine.compiler(params)
        if self.schema:
            tables = compiler.tables
            compiler.tables = lambda schema, name: tables(schema or self.schema, name)
        return compiler

    # -- reads

    def dataframe(self, projection: Any = None, filter: Any = None, params: Mapping[str, Any] | None = None, sort: Any = None, offset: int | None = None, limit: int | None = None, distinct: bool = False, max_sub_queries: int = MAX_SUB_QUERIES, hint: Any = None) -> DataFrame:
        """The plan of a read: a struct ``_row`` with nested objects, and a list column for each to-many link."""
        return self._planned(projection, filter, params, sort, offset, limit, distinct, max_sub_queries, hint)[0]

    def _planned(self, projection: Any, filter: Any, params: Any, sort: Any, offset: Any, limit: Any, distinct: bool, max_sub_queries: int, hint: Any, most_linked: int | None = None):
        planner = Planner(self._compiler(params), max_sub_queries, most_linked)
        order = [sort] if isinstance(sort, str) else list(sort or [])
        order = [p.strip() for s in order for p in s.split(",")]
        return planner.read(self.meta, parse(projection), filter, order, offset, limit, distinct, hint)

    def find_many(
        self, projection: Any = None, filter: Any = None, params: Mapping[str, Any] | None = None, sort: Any = None, offset: int | None = None, limit: int | None = None, distinct: bool = False,
        max_eager_fetch: int = 100_000, max_sub_queries: int = MAX_SUB_QUERIES, on_transform_row: Callable | None = None, comment: str | None = None, optimizer_hint: Any = None,
    ) -> list[dict[str, Any]]:
        """Entities as dicts, in declaration order, without nulls. Uncapped unless ``limit`` is given."""
        return list(self.iterate(projection, filter, params, sort, offset, limit, distinct, max_eager_fetch, max_sub_queries, on_transform_row, comment, optimizer_hint))

    def iterate(self, projection: Any = None, filter: Any = None, params: Any = None, sort: Any = None, offset: Any = None, limit: Any = None, distinct: bool = False, max_eager_fetch: int = 100_000, max_sub_queries: int = MAX_SUB_QUERIES, on_transform_row: Callable | None = None, comment: str | None = None, optimizer_hint: Any = None) -> Iterator[dict[str, Any]]:
        """As ``find_many``, one by one."""
        df, shape = self._planned(projection, filter, params, sort, offset, limit, distinct, max_sub_queries, optimizer_hint, max_eager_fetch)
        if comment:
            self.engine.spark.sparkContext.setJobDescription(comment)
        lists = [c for c in df.columns if c.startswith("_m")]
        for row in df.toLocalIterator():
            values = [row[c] for c in lists]
            if any(v is not None and len(v) > max_eager_fetch for v in values):
                raise ModelError(f"more than {max_eager_fetch} linked rows")
            out = to_object(row["_row"], values, shape) or {}
            if on_transform_row:
                on_transform_row(self.meta, row, out)
            yield out

    def find_one(self, **options: Any) -> dict[str, Any] | None:
        return next(iter(self.find_many(**{**options, "limit": 1})), None)

    def find_by_id(self, key: Any, filter: Any = None, **options: Any) -> dict[str, Any] | None:
        return self.find_one(filter=predicates.And(key_values(self.meta, key), filter or {}), **options)

    def _matching(self, filter: Any, params: Any) -> DataFrame:
        q = queries.Select(elements.Raw("1 as one")).from_(Planner(self._compiler()).table(self.meta, "T"))
        if filter is not None:
            q.where(Planner(self._compiler()).filter(self.meta, "T", filter))
        return self._compiler(params).query(q)

    def count(self, filter: Any = None, params: Any = None) -> int:
        return self._matching(filter, params).count()

    def exists(self, key: Any, filter: Any = None, params: Any = None) -> bool:
        return self.exists_one(predicates.And(key_values(self.meta, key), filter or {}), params)

    def exists_one(self, filter: Any = None, params: Any = None) -> bool:
        return not self._matching(filter, params).isEmpty()

    # -- writes

    def _values(self, meta: Meta, given: Mapping[str, Any], insert: bool, prefix: str = "", suffix: str = "") -> dict[str, Any]:
        given = {k.lower(): v for k, v in given.items()}
        out: dict[str, Any] = {}
        for f in meta.fields.values():
            low = f.name.lower()
            if isinstance(f, Embedded):
                if low in given and given[low] is not None:
                    out |= self._values(meta_of(f.type), given[low], insert, prefix + f.prefix, f.suffix + suffix)
                continue
            if isinstance(f, Link) or (f.no_insert if insert else f.no_update) or (not insert and low not in given):
                continue
            value = given.get(low)
            if insert and value is None and f.default is not None:
                value = f.default(dict(given)) if callable(f.default) and not isinstance(f.default, Node) else f.default
            if f.serialize and not isinstance(value, Node):
                value = f.serialize(value, f.name)
            if insert and value is None and f.auto_generated:
                value = self._generated(meta, f, prefix + (f.field_name or f.name) + suffix)
            if value is None and f.not_null:
                raise ModelError(f"{f.name} must have a value")
            if f.enum is not None and value is not None and not isinstance(value, Node):
                allowed = list(f.enum)
                for v in value if isinstance(value, (list, tuple)) else [value]:
                    if v not in allowed:
                        raise ModelError(f"{f.name} must be one of {', '.join(map(str, allowed))}")
            if value is not None or (not insert and low in given):
                out[prefix + (f.field_name or f.name) + suffix] = value
        return out

    def _generated(self, meta: Meta, f: Column, name: str) -> Any:
        if f.data_type in _NUMBERS:
            catalog, counter = self.engine.catalog, f"{meta.table}.{name}"
            if counter.lower() not in catalog.counters:
                top = catalog.table(meta.schema or self.schema, meta.table).agg(F.max(f"`{name}`")).first()[0]
                catalog.counters[counter.lower()] = int(top or 0)
            return catalog.counter(counter)
        if f.data_type in (DataType.DATE, DataType.TIMESTAMP, DataType.TIMESTAMPTZ):
            return dt.datetime.now(dt.timezone.utc) if f.data_type is DataType.TIMESTAMPTZ else dt.datetime.now()
        return str(uuid.uuid4())

    def _target(self) -> elements.Table:
        t = elements.Table(self.meta.table)
        t.schema = self.schema or self.meta.schema
        return t

    def _key_fields(self) -> list[str]:
        return [c.field_name or c.name for c in self.meta.key]

    def create_only(self, values: Mapping[str, Any]) -> Any:
        """Insert a row; returns its key: a value, or a dict if it has several parts."""
        row = self._values(self.meta, values, True)
        if not row:
            raise ModelError("there is nothing to insert")
        self.engine.execute(queries.Insert(self._target(), row))
        key = {c.name: row.get(c.field_name or c.name) for c in self.meta.key}
        return next(iter(key.values())) if len(key) == 1 else key

    def create(self, values: Mapping[str, Any], projection: Any = None) -> dict[str, Any]:
        """Insert a row and read it back."""
        found = self.find_by_id(self.create_only(values), projection=projection)
        if found is None:
            raise ModelError("the created row can't be found")
        return found

    def update_many(self, values: Mapping[str, Any], filter: Any = None, params: Mapping[str, Any] | None = None) -> int:
        changes = self._values(self.meta, values, False)
        if not changes:
            return 0
        q = queries.Update(Planner(self._compiler()).table(self.meta, "T"), changes)
        q.table.schema = self.schema or self.meta.schema
        if filter is not None:
            q.where(Planner(self._compiler()).filter(self.meta, "T", filter))
        return self.engine.execute(q, params).rows_affected

    def update_only(self, key: Any, values: Mapping[str, Any], filter: Any = None, params: Any = None) -> bool:
        keys = key_values(self.meta, key)
        rest = {k: v for k, v in values.items() if k.lower() not in {c.name.lower() for c in self.meta.key}}
        return self.update_many(rest, predicates.And(keys, filter or {}), params) > 0

    def update(self, key: Any, values: Mapping[str, Any], projection: Any = None, filter: Any = None, params: Any = None) -> dict[str, Any] | None:
        return self.find_by_id(key, projection=projection) if self.update_only(key, values, filter, params) else None

    def delete_many(self, filter: Any = None, params: Any = None) -> int:
        q = queries.Delete(Planner(self._compiler()).table(self.meta, "T"))
        q.table.schema = self.schema or self.meta.schema
        if filter is not None:
            q.where(Planner(self._compiler()).filter(self.meta, "T", filter))
        return self.engine.execute(q, params).rows_affected

    def delete(self, key: Any, filter: Any = None, params: Any = None) -> bool:
        return self.delete_many(predicates.And(key_values(self.meta, key), filter or {}), params) > 0


class BaseEntity:
    """Optional base: takes column values, knows whether it is stored, can be deleted."""

    def __init__(self, **values: Any):
        meta = meta_of(type(self))
        given = {k.lower(): v for k, v in values.items()}
        for name in meta.names():
            setattr(self, name, given.get(name.lower()))

    def exists(self, engine: Engine) -> bool:
        return Repository(engine, type(self)).exists(self)

    def destroy(self, engine: Engine) -> bool:
        return Repository(engine, type(self)).delete(self)
