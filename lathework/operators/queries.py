"""Select, Union, Insert, Update and Delete."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from .base import Aliased, Node, split_columns
from .elements import Field, GroupColumn, Join, OrderColumn, Raw, ReturningColumn, Table
from .predicates import And


class Query(Aliased):
    """Common to all queries: bound values, comments, and listeners for ``serialize``, ``execute`` and ``fetch``."""

    def __init__(self):
        self.params: dict[str, Any] = {}
        self.comments: list[tuple[str, tuple[str, ...]]] = []
        self.listeners: dict[str, list[Callable]] = {}

    def values(self, params: Mapping[str, Any]):
        if not isinstance(params, Mapping):
            raise TypeError("values() takes a mapping")
        self.params = dict(params)
        return self

    def comment(self, text: str, dialects: list[str] | None = None):
        self.comments.append((text, tuple(dialects or ())))
        return self

    def on(self, event: str, listener: Callable):
        self.listeners.setdefault(event, []).append(listener)
        return self

    def generate(self, dialect: str | None = None, params: Mapping[str, Any] | None = None, strict_params: bool = False, pretty: bool = False, dialect_version: str | None = None):
        """The query as text of a dialect; see ``lathework.text``."""
        from ..text import generate

        return generate(self, dialect, params, strict_params, pretty, dialect_version)


class Select(Query):
    kind = "select"

    def __init__(self, *columns: Any):
        super().__init__()
        self.columns: list[Node] = []
        self.tables: list[Node] = []
        self.joins: list[Join] = []
        self.condition: And | None = None
        self.groups: list[Node] = []
        self.order: list[Node] = []
        self.limited: int | None = None
        self.skipped: int | None = None
        self.unique = False
        self.add_column(*columns)

    def add_column(self, *columns: Any) -> Select:
        for c in columns:
            if isinstance(c, (list, tuple)):
                self.add_column(*c)
            elif isinstance(c, Node):
                self.columns.append(c)
            elif c:
                self.columns += [Field(x) for x in split_columns(c)]
        return self

    def from_(self, *tables: Any) -> Select:
        """The tables; a second call replaces the first one's. Several tables are joined with commas."""
        self.tables = [Table(t) if isinstance(t, str) else t for t in tables if t]
        return self

    def join(self, *joins: Join) -> Select:
        for j in joins:
            if not j:
                continue
            if not isinstance(j, Join):
                raise TypeError("Join statement required")
            self.joins.append(j)
        return self

    def where(self, *conditions: Any) -> Select:
        self.condition = (self.condition or And()).add(*conditions)
        return self

    def group_by(self, *columns: Any) -> Select:
        self.groups += [GroupColumn(c) if isinstance(c, str) else c for c in columns if c]
        return self

    def order_by(self, *columns: Any) -> Select:
        self.order += [OrderColumn(c) if isinstance(c, str) else c for c in columns if c]
        return self

    def limit(self, n: int | str | None) -> Select:
        self.limited = None if n is None else int(n)
        return self

    def offset(self, n: int | str | None) -> Select:
        self.skipped = None if n is None else int(n)
        return self

    def distinct(self) -> Select:
        self.unique = True
        return self

    def on_fetch(self, listener: Callable) -> Select:
        return self.on("fetch", listener)

    def once_fetch(self, listener: Callable) -> Select:
        def once(*args: Any) -> None:
            self.listeners["fetch"].remove(once)
            listener(*args)

        return self.on("fetch", once)


class Union(Query):
    """Rows of several queries by position; distinct unless ``"all"``."""

    kind = "union"

    def __init__(self, queries: list[Query], mode: str | None = None):
        super().__init__()
        self.queries = list(queries)
        self.all = (mode or "").lower() == "all"


class _Returning(Query):
    def __init__(self):
        super().__init__()
        self.returned: list[ReturningColumn] = []

    def returning(self, *columns: str):
        self.returned = [ReturningColumn(x) for c in columns for x in split_columns(c)]
        return self


def _target(table: Any) -> Node:
    if isinstance(table, str):
        return Table(table)
    if isinstance(table, (Table, Raw)):
        return table
    raise TypeError("a table name, Table or Raw is needed")


class Insert(_Returning):
    """Insert one row (a mapping) or a query's rows."""

    kind = "insert"

    def __init__(self, table: str | Node, source: Mapping[str, Any] | Query | Raw):
        super().__init__()
        if not isinstance(source, (Mapping, Select, Union, Raw)):
            raise TypeError("Insert takes a mapping, a Select or Raw")
        self.table, self.source = _target(table), source


class _Filtered(_Returning):
    condition: And | None = None

    def where(self, *conditions: Any):
        self.condition = (self.condition or And()).add(*conditions)
        return self


class Update(_Filtered):
    kind = "update"

    def __init__(self, table: str | Node, changes: Mapping[str, Any]):
        super().__init__()
        if not isinstance(changes, Mapping):
            raise TypeError("Update takes a mapping")
        self.table, self.changes = _target(table), dict(changes)


class Delete(_Filtered):
    kind = "delete"

    def __init__(self, table: str | Node):
        super().__init__()
        self.table = _target(table)
