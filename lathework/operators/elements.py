"""Columns, tables, expressions and joins."""

from __future__ import annotations

from collections.abc import Sequence as Seq
from typing import Any

from .base import Aliased, Node, match_column, match_order, match_table
from .types import DataType


class Field(Aliased):
    """A column, ``*`` or ``table.*``; may say its type and whether it holds an array."""

    kind = "field"

    def __init__(self, column: str, data_type: DataType | None = None, is_array: bool = False):
        if column.endswith("[]"):
            column, is_array = column[:-2], True
        self.schema, self.table, self.name, self.alias = match_column(column)
        self.data_type, self.is_array = data_type, is_array


class GroupColumn(Node):
    kind = "group_column"

    def __init__(self, column: str):
        self.schema, self.table, self.name, alias = match_column(column)
        if alias or self.name == "*":
            raise ValueError(f"{column!r} is not a group column")


class OrderColumn(Node):
    kind = "order_column"

    def __init__(self, column: str):
        self.schema, self.table, self.name, self.descending = match_order(column)


class ReturningColumn(Node):
    kind = "returning_column"

    def __init__(self, column: str):
        schema, table, self.name, self.alias = match_column(column)
        if schema or table or self.name == "*":
            raise ValueError(f"{column!r} is not a returning column: field [as alias]")


class Table(Node):
    """``[schema.]table [alias]`` with hints: a text, several, or {dialect: text}."""

    kind = "table"

    def __init__(self, name: str, hint: str | Seq[str] | dict[str, str] | None = None):
        self.schema, self.name, self.alias = match_table(name)
        if isinstance(hint, dict):
            self.hints = [(d, h) for d, h in hint.items()]
        else:
            self.hints = [(None, h) for h in ([hint] if isinstance(hint, str) else hint or [])]


class Raw(Node):
    """Text that goes into the query as it is."""

    kind = "raw"

    def __init__(self, text: str):
        self.text = text


class Case(Aliased):
    """``Case().when(condition, ...).then(value).else_(value)``; conditions of one ``when`` are joined by AND."""

    kind = "case"

    def __init__(self):
        self.branches: list[tuple[Node, Any]] = []
        self.otherwise: Any = None
        self.has_otherwise = False
        self._condition: Node | None = None

    def when(self, *conditions: Any) -> Case:
        from .predicates import And

        self._condition = And(*conditions) if conditions else None
        return self

    def then(self, value: Any) -> Case:
        if self._condition is not None:
            self.branches.append((self._condition, value))
            self._condition = None
        return self

    def else_(self, value: Any) -> Case:
        self.otherwise, self.has_otherwise = value, True
        return self


class Call(Aliased):
    """A function over expressions; plain strings are text values, columns are ``Field``."""

    kind = "call"
    function = ""

    def __init__(self, *args: Any):
        self.args = args


class Coalesce(Call):
    kind, function = "coalesce", "coalesce"


class Lower(Call):
    kind, function = "lower", "lower"


class Upper(Call):
    kind, function = "upper", "upper"


class Max(Call):
    kind, function = "max", "max"


class Min(Call):
    kind, function = "min", "min"


class Count(Call):
    """Number of rows."""

    kind, function = "count", "count"

    def __init__(self):
        super().__init__()


class StringAgg(Aliased):
    """Texts of a group joined by a delimiter, in an order if one is given. A string names a column."""

    kind = "string_agg"

    def __init__(self, field: str | Node, delimiter: str = ","):
        self.field = Field(field) if isinstance(field, str) else field
        self.separator = delimiter
        self.order: list[Node] = []

    def delimiter(self, text: str) -> StringAgg:
        self.separator = text
        return self

    def order_by(self, *columns: str | Node) -> StringAgg:
        self.order += [OrderColumn(c) if isinstance(c, str) else c for c in columns if c]
        return self


class Param(Node):
    """A value given when the query runs."""

    kind = "param"

    def __init__(self, name: str, data_type: DataType | None = None, is_array: bool = False):
        self.name, self.data_type, self.is_array = name, data_type, is_array


class Sequence(Aliased):
    """Next or current value of a counter."""

    kind = "sequence"

    def __init__(self, name: str, advance: bool = False):
        self.name, self.advance = name, advance

    def next(self, advance: bool = True) -> Sequence:
        self.advance = advance
        return self


class Join(Node):
    """A join with a table, a named sub-select or raw text; ``on`` conditions add up."""

    kind = "join"
    how = "inner"

    def __init__(self, table: str | Node):
        self.table = Table(table) if isinstance(table, str) else table
        self.condition: Any = None

    def on(self, *conditions: Any) -> Join:
        from .predicates import And

        if self.condition is None:
            self.condition = And()
        self.condition.add(*conditions)
        return self


class InnerJoin(Join):
    how = "inner"


class LeftJoin(Join):
    how = "left"


class LeftOuterJoin(Join):
    how = "left outer"


class RightJoin(Join):
    how = "right"


class RightOuterJoin(Join):
    how = "right outer"


class OuterJoin(Join):
    how = "outer"


class FullOuterJoin(Join):
    how = "full outer"


class CrossJoin(Join):
    how = "cross"
