"""Query objects as SQL text.

A ``Writer`` has one method for each node kind. A query's ``serialize`` listeners come first, then rules
registered for the dialect, then the dialect's own method. Any of them may return None to pass on.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..operators import base, elements, predicates, queries

# The words that every dialect quotes.
RESERVED = frozenset(
    """schema table field index foreign key select insert update delete with merge join inner outer left right full
    from where order by group having acs ascending dsc descending distinct and or not between null like ilike count
    sum average avg cascade authorization create add drop alter private sequence default constraint references
    primary user password""".split()
)

#: Characters after which a list of pretty text goes on in a new line.
LINE = 60

Rule = Callable[["Writer", base.Node, Callable[[], str]], "str | None"]


@dataclass
class Extension:
    """Rules for a dialect: ``rules[kind](writer, node, default)`` and more reserved words."""

    dialect: str
    rules: dict[str, Rule] = field(default_factory=dict)
    reserved: frozenset[str] = frozenset()


_extensions: list[Extension] = []


def register(extension: Extension) -> None:
    _extensions.append(extension)


def unregister(extension: Extension) -> None:
    _extensions.remove(extension)


def registered() -> list[Extension]:
    return list(_extensions)


@dataclass
class Generated:
    sql: str
    params: Any
    param_options: Any
    returning: list[tuple[str, str | None]]


class Writer:
    dialect: str | None = None
    null_rule = False  # whether = null becomes is null
    reserved: frozenset[str] = frozenset()

    def __init__(self, root: queries.Query, params: Mapping[str, Any] | None = None, strict: bool = False, pretty: bool = False, version: str | None = None):
        self.root, self.strict, self.pretty, self.version = root, strict, pretty, version
        self.params = {**(params or {}), **root.params}
        self.bound: Any = {}
        self.options: Any = {}
        self.returning: list[tuple[str, str | None]] = []
        self._made = 0

    # -- entry points

    def generated(self) -> Generated:
        sql = self.write(self.root)
        notes = [t.replace("\n", "\n  ") for t, d in self.root.comments if not self.dialect or not d or self.dialect in d]
        if notes:
            sql = "/*" + "\n".join(notes) + "*/\n" + sql
        return Generated(sql, self.bound, self.options, self.returning)

    def write(self, node: base.Node) -> str:
        def default() -> str:
            return getattr(self, f"_{node.kind}")(node)

        for hook in self.root.listeners.get("serialize", ()):
            if (text := hook(self, node, default)) is not None:
                return text
        for e in _extensions:
            if e.dialect == self.dialect and node.kind in e.rules and (text := e.rules[node.kind](self, node, default)) is not None:
                return text
        return default()

    def value(self, x: Any) -> str:
        """A value or node where an expression stands; queries and logical operators get parentheses."""
        if isinstance(x, base.Node):
            text = self.write(x)
            return f"({text})" if text and isinstance(x, (queries.Query, predicates.Logical)) else text
        if x is None:
            return "null"
        if isinstance(x, bool):
            return self.boolean(x)
        if isinstance(x, (list, tuple, set, frozenset)):
            return "(" + ",".join(self.value(v) for v in x) + ")"
        if isinstance(x, (dt.datetime, dt.date)):
            return self.date(x)
        if isinstance(x, (int, float, decimal.Decimal)):
            return str(x)
        if isinstance(x, str):
            return self.string(x)
        return self.string(json.dumps(x, default=str, separators=(",", ":")))

    # -- values

    def string(self, x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def boolean(self, x: bool) -> str:
        return "true" if x else "false"

    def date(self, x: dt.date) -> str:
        if isinstance(x, dt.datetime):
            if x.tzinfo:
                x = x.astimezone(dt.timezone.utc)
            if x.hour or x.minute or x.second:
                return f"'{x:%Y-%m-%d %H:%M:%S}'"
        return f"'{x:%Y-%m-%d}'"

    def name(self, word: str) -> str:
        low = word.lower()
        if low in RESERVED or low in self.reserved or any(e.dialect == self.dialect and low in e.reserved for e in _extensions):
            return self.quoted(word)
        return word

    def quoted(self, word: str) -> str:
        return f'"{word}"'

    def path(self, schema: str | None, table: str | None, name: str) -> str:
        before = "".join(f"{x}." for x in (schema, table) if x)
        return before + (name if before or name == "*" else self.name(name))

    def placeholder(self, name: str, value: Any, node: elements.Param) -> str:
        self.bound[name] = value
        self.options[name] = {"data_type": node.data_type, "is_array": node.is_array}
        return f":{name}"

    def _with_alias(self, text: str, alias: str | None, word: str = " ") -> str:
        return f"{text}{word}{self.name(alias)}" if text and alias else text

    # -- expressions

    def _field(self, n: elements.Field) -> str:
        return self._with_alias(self.path(n.schema, n.table, n.name), n.alias, " as ")

    def _group_column(self, n: elements.GroupColumn) -> str:
        return self.path(n.schema, n.table, n.name)

    def _order_column(self, n: elements.OrderColumn) -> str:
        return self.path(n.schema, n.table, n.name) + (" desc" if n.descending else "")

    def _returning_column(self, n: elements.ReturningColumn) -> str:
        self.returning.append((n.name, n.alias))
        return self._with_alias(self.name(n.name), n.alias, " as ")

    def _table(self, n: elements.Table) -> str:
        text = f"{n.schema}.{n.name}" if n.schema else self.name(n.name)
        return f"{text} {n.alias}" if n.alias else text

    def _raw(self, n: elements.Raw) -> str:
        return n.text

    def _case(self, n: elements.Case) -> str:
        if not n.branches:
            return ""
        parts = [f"when {self.write(c)} then {self.value(v)}" for c, v in n.branches]
        if n.has_otherwise:
            parts.append(f"else {self.value(n.otherwise)}")
        return self._with_alias(f"case {' '.join(parts)} end", n.alias)

    def _call(self, n: elements.Call) -> str:
        if any(a is None or a == "" for a in n.args if not isinstance(a, base.Node)) and n.kind != "coalesce":
            return ""
        return self._with_alias(f"{n.function}({', '.join(self.value(a) for a in n.args)})", n.alias)

    _coalesce = _lower = _upper = _max = _min = _call

    def _count(self, n: elements.Count) -> str:
        return self._with_alias("count(*)", n.alias)

    def _string_agg(self, n: elements.StringAgg) -> str:
        order = f" order by {', '.join(self.write(o) for o in n.order)}" if n.order else ""
        return self._with_alias(f"string_agg({self.value(n.field)},{self.string(n.separator)}{order})", n.alias)

    def _param(self, n: elements.Param) -> str:
        value = self.params.get(n.name)
        if n.is_array and value is not None and not isinstance(value, (list, tuple)):
            value = [value]
        return self.placeholder(n.name, value, n)

    def _sequence(self, n: elements.Sequence) -> str:
        return self._with_alias(f"{'nextval' if n.advance else 'currval'}('{n.name}')", n.alias)

    def _join(self, n: elements.Join) -> str:
        if isinstance(n.table, queries.Select) and not n.table.alias:
            raise ValueError("Alias required for sub-select in join")
        table = f"({self.write(n.table)}) {n.table.alias}" if isinstance(n.table, queries.Query) else self.write(n.table)
        on = self.write(n.condition) if n.condition else ""
        return f"{n.how} join {table}" + (f" on {on}" if on else "")

    # -- conditions

    def operand(self, n: predicates.Comparison) -> tuple[Any, Any]:
        """The right side as it will be written, and its value if that is known."""
        right = n.right
        if self.strict and not isinstance(right, base.Node):
            self._made += 1
            name = f"P$_{self._made}"
            self.params[name] = right
            left = n.left if isinstance(n.left, elements.Field) else None
            right = elements.Param(name, left.data_type if left else None, bool(left and left.is_array) or isinstance(right, list))
        if isinstance(right, elements.Param):
            return right, self.params.get(right.name)
        if isinstance(right, elements.Raw) and right.text.strip().lower() == "null":
            return right, None
        return right, right

    def _comparison(self, n: predicates.Comparison) -> str:
        if n.empty:
            return ""
        left = self.value(n.left)
        if n.operator in ("between", "not_between"):
            low, high = (self.value(self.operand(predicates.Eq(n.left, b))[0]) for b in n.right)
            return f"{left} {n.symbol} {low} and {high}"
        right, value = self.operand(n)
        return self.compared(n, left, right, value)

    def compared(self, n: predicates.Comparison, left: str, right: Any, value: Any) -> str:
        if self.null_rule and value is None and n.operator in ("eq", "ne"):
            return f"{left} {'is' if n.operator == 'eq' else 'is not'} null"
        return f"{left} {n.symbol} {self.value(right)}"

    def _logical(self, n: predicates.Logical) -> str:
        return self.listed([t for t in (self.value(i) for i in n.items) if t], f" {n.word}")

    def _not(self, n: predicates.Not) -> str:
        text = self.value(n.condition)
        return f"not {text}" if text else ""

    def _exists(self, n: predicates.Exists) -> str:
        return f"{'not ' if n.negated else ''}exists ({self.write(n.query)})"

    # -- queries

    def lines(self, *parts: str) -> str:
        return ("\n" if self.pretty else " ").join(p for p in parts if p)

    def listed(self, items: list[str], separator: str = ",") -> str:
        """Items in a row; pretty text starts an indented line once one has passed LINE characters."""
        lines, line = [], ""
        for i, item in enumerate(items):
            if self.pretty and len(line) > LINE:
                lines.append(line)
                line = ""
            line += (" " if line else "") + item + (separator if i < len(items) - 1 else "")
        return "\n  ".join([*lines, line])

    def nested(self, text: str) -> str:
        return text.replace("\n", "\n  ")

    def _columns(self, n: queries.Select) -> str:
        out = []
        for c in n.columns:
            text = self.value(c)
            if isinstance(c, queries.Query):
                if not c.alias:
                    raise ValueError("Alias required for sub-select in columns")
                text = f"{text} {c.alias}"
            out.append(text)
        return self.listed([t for t in out if t]) or "*"

    def _from(self, n: queries.Select) -> str:
        out = []
        for t in n.tables:
            if isinstance(t, queries.Query):
                if not t.alias:
                    raise ValueError('Alias required for sub-select in "from"')
                text = f"({self.write(t)}) {t.alias}"
                out.append("\n  " + self.nested(text) if self.pretty else text)
            else:
                out.append(self.write(t))
        text = ",".join(out)
        return f"from{'' if text[:1] == chr(10) else ' '}{text}" if text else ""

    def hint(self, n: queries.Select) -> str:
        return ""

    def _body(self, n: queries.Select) -> str:
        where = self.write(n.condition) if n.condition else ""
        columns, tables = self._columns(n), self._from(n)
        head = " ".join(x for x in ("select", "distinct" if n.unique else "", self.hint(n)) if x)
        broken = "\n" in columns
        head += ("\n  " if broken else " ") + columns
        if tables and not (self.pretty and (broken or len(columns) > LINE)):
            head, tables = f"{head} {tables}", ""
        return self.lines(
            head,
            tables,
            *[self.write(j) for j in n.joins],
            f"where {where}" if where else "",
            f"group by {self.listed([self.write(g) for g in n.groups])}" if n.groups else "",
            f"order by {self.listed([self.value(o) for o in n.order])}" if n.order else "",
        )

    def _select(self, n: queries.Select) -> str:
        return self.paged(n, self._body(n), n.limited or 0, max(n.skipped or 0, 0))

    def paged(self, n: queries.Select, body: str, limit: int, offset: int) -> str:
        return body

    def _union(self, n: queries.Union) -> str:
        return self.lines(*[x for i, q in enumerate(n.queries) for x in ([f"union{' all' if n.all else ''}"] if i else []) + [self.write(q)]])

    def _returned(self, n: Any) -> str:
        columns = ", ".join(self.write(c) for c in n.returned)
        return f"returning {columns}" if columns else ""

    def _insert(self, n: queries.Insert) -> str:
        if isinstance(n.source, Mapping):
            columns, values = self.listed(list(n.source)), self.listed([self.value(v) for v in n.source.values()])
        else:
            names = [getattr(c, "alias", None) or getattr(c, "name", None) for c in getattr(n.source, "columns", [])]
            columns, values = self.listed([x for x in names if x]), self.write(n.source)
        gap = "\n  " if self.pretty else " "
        return self.lines(f"insert into {self.write(n.table)}{gap}({self.nested(columns)})", self.inserted(n, values, gap), self._returned(n))

    def inserted(self, n: queries.Insert, values: str, gap: str) -> str:
        return f"values{gap}({self.nested(values)})"

    def _update(self, n: queries.Update) -> str:
        where = self.write(n.condition) if n.condition else ""
        sets = self.listed([f"{k} = {self.value(v)}" for k, v in n.changes.items()])
        return self.lines(f"update {self.write(n.table)} set{chr(10) + '  ' if self.pretty else ' '}{sets}", f"where {where}" if where else "", self._returned(n))

    def _delete(self, n: queries.Delete) -> str:
        where = self.write(n.condition) if n.condition else ""
        return self.lines(f"delete from {self.write(n.table)}", f"where {where}" if where else "")
