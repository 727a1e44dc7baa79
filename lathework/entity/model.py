"""Declaring entities: columns, embedded objects and links, and what is known about them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from ..operators.types import DataType, from_python, spark_type

_registry: dict[str, type] = {}


class ModelError(ValueError):
    """A declaration that can't be used."""


@dataclass
class Column:
    type: Any = None
    field_name: str | None = None
    data_type: DataType | None = None
    comment: str | None = None
    default: Any = None
    is_array: bool = False
    enum: Any = None
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    collation: str | None = None
    auto_generated: bool = False
    not_null: bool = False
    no_update: bool = False
    no_insert: bool = False
    parse: Callable | None = None
    serialize: Callable | None = None
    hidden: bool = False
    exclusive: bool = False
    primary_key: bool = False
    foreign_key: tuple[Any, str | None] | None = None
    index: bool | dict = False
    name: str = ""

    def __post_init__(self):
        if self.data_type is None:
            self.data_type, many = from_python(self.type) if not (isinstance(self.type, type) and hasattr(self.type, "__entity__")) else (DataType.JSON, False)
            self.is_array = self.is_array or many


@dataclass
class Embedded:
    type: Any
    prefix: str = ""
    suffix: str = ""
    hidden: bool = False
    exclusive: bool = False
    name: str = ""


@dataclass
class Hop:
    """One step of a link: the target, whether it is many, its keys and conditions."""

    target: Any
    many: bool
    source_key: str | None = None
    target_key: str | None = None
    where: Any = None


@dataclass
class Link:
    """A chain of hops; the value is the last target's."""

    hidden: bool = False
    exclusive: bool = False
    hops: list[Hop] = field(default_factory=list)
    name: str = ""

    def to_one(self, target: Any, source_key: str | None = None, target_key: str | None = None, where: Any = None) -> Link:
        self.hops.append(Hop(target, False, source_key, target_key, where))
        return self

    def to_many(self, target: Any, source_key: str | None = None, target_key: str | None = None, where: Any = None) -> Link:
        self.hops.append(Hop(target, True, source_key, target_key, where))
        return self

    def where(self, filter_: Any) -> Link:
        self.hops[-1].where = filter_
        return self

    @property
    def many(self) -> bool:
        return any(h.many for h in self.hops)


def column(type: Any = None, **options: Any) -> Any:
    """A column; ``type`` is a Python type or a DataType."""
    if isinstance(type, DataType):
        options["data_type"] = type
        type = None
    return Column(type, **options)


def primary_key(type: Any = int, **options: Any) -> Any:
    return column(type, primary_key=True, **options)


def embedded(type: Any, prefix: str = "", suffix: str = "", **options: Any) -> Any:
    return Embedded(type, prefix, suffix, **options)


def link(**options: Any) -> Any:
    return Link(**options)


@dataclass
class Index:
    columns: tuple[str, ...]
    name: str | None = None
    unique: bool = False
    primary: bool = False


@dataclass
class Meta:
    cls: type
    name: str
    table: str | None
    schema: str | None = None
    comment: str | None = None
    fields: dict[str, Column | Embedded | Link] = field(default_factory=dict)  # by lower-case name, as declared
    indexes: list[Index] = field(default_factory=list)
    listeners: dict[str, list[Callable]] = field(default_factory=dict)

    def field(self, name: str) -> Column | Embedded | Link | None:
        return self.fields.get(name.lower())

    def column(self, name: str) -> Column | None:
        found = self.field(name)
        return found if isinstance(found, Column) else None

    def find(self, path: str) -> Column | Embedded | Link | None:
        """A field by a dotted path through embedded objects and links."""
        meta: Meta | None = self
        found = None
        for part in path.split("."):
            if meta is None:
                return None
            found = meta.field(part)
            meta = meta_of(found.type) if isinstance(found, Embedded) else meta_of(found.hops[-1].target) if isinstance(found, Link) else None
        return found

    def names(self, kind: type | None = None) -> list[str]:
        return [f.name for f in self.fields.values() if kind is None or isinstance(f, kind)]

    @property
    def columns(self) -> list[Column]:
        return [f for f in self.fields.values() if isinstance(f, Column)]

    @property
    def key(self) -> list[Column]:
        """The primary key's columns."""
        for i in self.indexes:
            if i.primary:
                return [c for n in i.columns if (c := self.column(n))]
        return [c for c in self.columns if c.primary_key]

    def insert_names(self) -> list[str]:
        return [c.name for c in self.columns if not c.no_insert]

    def update_names(self) -> list[str]:
        return [c.name for c in self.columns if not c.no_update]

    def foreign_keys(self) -> list[tuple[str, Meta, str | None]]:
        return [(c.name, meta_of(c.foreign_key[0]), c.foreign_key[1]) for c in self.columns if c.foreign_key]

    def physical(self, prefix: str = "", suffix: str = "") -> list[tuple[str, Column]]:
        """(column name, declaration) of all columns, those of embedded objects included."""
        out: list[tuple[str, Column]] = []
        for f in self.fields.values():
            if isinstance(f, Column):
                out.append((prefix + (f.field_name or f.name) + suffix, f))
            elif isinstance(f, Embedded):
                out += meta_of(f.type).physical(prefix + f.prefix, f.suffix + suffix)
        return out

    def schema_type(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(c.data_type, c.is_array, c.precision, c.scale), True) for n, c in self.physical()])


def _collect(cls: type) -> dict[str, Column | Embedded | Link]:
    from copy import copy

    out: dict[str, Column | Embedded | Link] = {}
    for base in reversed(cls.__mro__):
        if hasattr(base, "__entity__") and "__entity__" in vars(base):
            out |= base.__entity__.fields
        for name, value in vars(base).items():
            if isinstance(value, (Column, Embedded, Link)):
                own = copy(value)
                own.name = name
                out[name.lower()] = own
    return out


def entity(table: str | None = None, schema: str | None = None, comment: str | None = None, name: str | None = None, primary: list[str] | None = None, indexes: list[Index] | None = None) -> Callable[[type], type]:
    """Class decorator: collects the fields, inherited ones first, and registers the entity by name."""

    def decorate(cls: type) -> type:
        parent = getattr(cls, "__entity__", None)
        fields = _collect(cls)
        meta = Meta(cls, name or cls.__name__, table or (parent.table if parent else None) or (name or cls.__name__).lower(), schema or (parent.schema if parent else None), comment, fields)
        meta.indexes = [*(indexes or []), *([Index(tuple(primary), primary=True)] if primary else [])]
        for c in meta.columns:
            if c.index:
                meta.indexes.append(Index((c.name,), **(c.index if isinstance(c.index, dict) else {})))
        meta.listeners = {k: list(v) for k, v in (parent.listeners if parent else {}).items()}
        for f in vars(cls).values():
            for event in getattr(f, "__entity_events__", ()):
                meta.listeners.setdefault(event, []).append(f)
        cls.__entity__ = meta
        _registry[meta.name.lower()] = cls
        return cls

    return decorate


def _event(event: str) -> Callable[[Callable], Callable]:
    def mark(f: Callable) -> Callable:
        f.__entity_events__ = (*getattr(f, "__entity_events__", ()), event)
        return f

    return mark


#: Listeners are recorded only; nothing fires them.
before_insert, after_insert = _event("before-insert"), _event("after-insert")
before_update, after_update = _event("before-update"), _event("after-update")
before_destroy, after_destroy = _event("before-destroy"), _event("after-destroy")


def meta_of(target: Any) -> Meta:
    """Metadata of an entity class, its name, or a function that returns either."""
    if isinstance(target, Meta):
        return target
    if isinstance(target, str):
        if target.lower() not in _registry:
            raise ModelError(f"there is no entity {target}")
        target = _registry[target.lower()]
    if not isinstance(target, type) and callable(target):
        return meta_of(target())
    if not hasattr(target, "__entity__"):
        raise ModelError(f"{target!r} is no entity")
    return target.__entity__


def _snake(name: str) -> str:
    return name[0].lower() + name[1:]


def _camel(name: str) -> str:
    return re.sub(r"_+([a-zA-Z0-9])", lambda m: m[1].upper(), name)


def keys_of(source: Meta, hop: Hop) -> tuple[Column, Column]:
    """(source column, target column) of a hop: as given, by a foreign key either way, or by the primary key's name."""
    target = meta_of(hop.target)
    source_key, target_key = hop.source_key, hop.target_key
    if not (source_key and target_key):
        for a, b, flipped in ((source, target, False), (target, source, True)):
            for name, to, to_key in a.foreign_keys():
                if to is b:
                    to_key = to_key or (b.key[0].name if len(b.key) == 1 else "id")
                    return _both(source, target, *((to_key, name) if flipped else (name, to_key)))
        one, other = (source, target) if hop.many else (target, source)
        key = (source_key if hop.many else target_key) or (one.key[0].name if len(one.key) == 1 else "id")
        guess = f"{_snake(one.name)}_{key}"
        far = (target_key if hop.many else source_key) or (guess if other.column(guess) else _camel(guess))
        source_key, target_key = (key, far) if hop.many else (far, key)
    return _both(source, target, source_key, target_key)


def _both(source: Meta, target: Meta, source_key: str, target_key: str) -> tuple[Column, Column]:
    a, b = source.column(source_key), target.column(target_key)
    if a is None or b is None:
        raise ModelError(f"{source.name} and {target.name} have no keys {source_key} and {target_key}")
    return a, b


# -- schema algebra


def _derived(name: str, fields: dict[str, Any], like: Meta) -> type:
    cls = type(name, (), {})
    keep = [i for i in like.indexes if all(n.lower() in fields for n in i.columns)]
    cls.__entity__ = Meta(cls, name, like.table, like.schema, like.comment, fields, keep)
    return cls


def pick(base: Any, names: list[str], name: str | None = None) -> type:
    """An entity with some of the fields."""
    meta, low = meta_of(base), {n.lower() for n in names}
    return _derived(name or f"{meta.name}Pick", {k: f for k, f in meta.fields.items() if k in low}, meta)


def omit(base: Any, names: list[str], name: str | None = None) -> type:
    meta, low = meta_of(base), {n.lower() for n in names}
    return _derived(name or f"{meta.name}Omit", {k: f for k, f in meta.fields.items() if k not in low}, meta)


def union(*bases: Any, name: str | None = None) -> type:
    """An entity with the fields of all; later ones win, the first gives the table."""
    metas = [meta_of(b) for b in bases]
    fields: dict[str, Any] = {}
    for m in metas:
        fields |= m.fields
    return _derived(name or "".join(m.name for m in metas), fields, metas[0])


def mixin(target: Any, *sources: Any) -> type:
    """Add the sources' fields that the target doesn't have."""
    meta = meta_of(target)
    for s in sources:
        for k, f in meta_of(s).fields.items():
            meta.fields.setdefault(k, f)
    return meta.cls
