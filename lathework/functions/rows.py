"""Result rows: field names, shapes, null dropping and value transforms, at the driver's edge."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as T

from ..operators.types import DataType, from_spark

Naming = "str | Callable[[str], str | None] | None"


@dataclass(frozen=True)
class FieldInfo:
    index: int
    name: str
    field_name: str  # as the query names it
    data_type: DataType
    is_array: bool
    nullable: bool
    precision: int | None = None
    scale: int | None = None


class FieldMap:
    """Fields by position or by name in any case."""

    def __init__(self, infos: Sequence[FieldInfo]):
        self.infos = list(infos)
        self._by_name = {f.name.upper(): f for f in self.infos}

    def get(self, key: int | str) -> FieldInfo | None:
        if isinstance(key, int):
            return self.infos[key] if 0 <= key < len(self.infos) else None
        return self._by_name.get(key.upper())

    def __iter__(self):
        return iter(self.infos)

    def __len__(self) -> int:
        return len(self.infos)


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^0-9A-Za-z]+", name) if w]


def _camel(name: str) -> str:
    words = _words(name)
    if len(words) <= 1 and not name.isupper():
        return name[:1].lower() + name[1:]
    joined = "".join(w[:1].upper() + w[1:].lower() for w in words)
    return joined[:1].lower() + joined[1:]


def rename(name: str, naming: Any) -> str | None:
    """A field's name under a strategy: lowercase, uppercase, camelcase, pascalcase or a function (None drops it)."""
    if naming is None:
        return name
    if callable(naming):
        return naming(name)
    strategy = naming.lower()
    if strategy == "original":
        return name
    if strategy == "lowercase":
        return name.lower()
    if strategy == "uppercase":
        return name.upper()
    if strategy == "camelcase":
        return _camel(name)
    if strategy == "pascalcase":
        camel = _camel(name)
        return camel[:1].upper() + camel[1:]
    raise ValueError(f"there is no naming strategy {naming!r}")


def named_fields(schema: T.StructType, naming: Any = None) -> FieldMap:
    out = []
    for i, f in enumerate(schema.fields):
        name = rename(f.name, naming)
        if name:
            kind, many = from_spark(f.dataType)
            exact = f.dataType if isinstance(f.dataType, T.DecimalType) else None
            out.append(FieldInfo(i, name, f.name, kind, many, f.nullable, exact.precision if exact else None, exact.scale if exact else None))
    return FieldMap(out)


def plain(x: Any) -> Any:
    """Rows inside values as dicts."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def shaped_rows(rows: Sequence[Row], info: FieldMap, objects: bool | None = True, ignore_nulls: bool | None = False, transform: Callable[[Any, FieldInfo], Any] | None = None) -> list[Any]:
    """Dicts or lists; values are transformed first, then nulls are dropped (from dicts only)."""
    out: list[Any] = []
    for row in rows:
        values = [plain(row[f.index]) for f in info]
        if transform:
            values = [transform(v, f) for v, f in zip(values, info, strict=True)]
        if objects:
            out.append({f.name: v for f, v in zip(info, values, strict=True) if not (ignore_nulls and v is None)})
        else:
            out.append(values)
    return out


def renamed(df, naming: Any):
    """The DataFrame with its columns renamed (or dropped) by a strategy."""
    from pyspark.sql import functions as F

    info = named_fields(df.schema, naming)
    return df.select(*[F.col(f"`{f.field_name}`").alias(f.name) for f in info])
