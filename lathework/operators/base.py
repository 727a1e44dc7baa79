"""Base of all query objects, and the small grammars of their string forms."""

from __future__ import annotations

import re
from typing import Any


class Node:
    """A piece of a query. ``kind`` names it for text rules, hooks and the DataFrame compiler."""

    kind = "node"


class Aliased(Node):
    """An expression that can carry a column name."""

    alias: str | None = None

    def as_(self, alias: str):
        self.alias = alias
        return self


_NAME = r"[A-Za-z_][\w$]*"
_COLUMN = re.compile(rf"(?:({_NAME})\.)?(?:({_NAME})\.)?({_NAME}|\*)(?:\s+(?:as\s+)?({_NAME}))?", re.I)
_TABLE = re.compile(rf"(?:({_NAME})\.)?({_NAME})(?:\s+(?:as\s+)?({_NAME}))?", re.I)
_ORDER = re.compile(rf"([+-])?(?:({_NAME})\.)?(?:({_NAME})\.)?({_NAME})(?:\s+(asc|dsc|desc|ascending|descending))?", re.I)
_KEY = re.compile(r"([\w.$]+)(\[\])?(?:\s*(.*))?", re.S)


def split_columns(text: str) -> list[str]:
    """Cut at commas that stand outside quotes and brackets."""
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == "," and not quote and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    out.append(now.strip())
    return [x for x in out if x]


def match_column(text: str) -> tuple[str | None, str | None, str, str | None]:
    """(schema, table, field, alias) of a column's string form."""
    m = _COLUMN.fullmatch(text.strip())
    if not m:
        raise ValueError(f"{text!r} is not a column: [schema.][table.]field [as alias]")
    schema, table, field, alias = m.groups()
    if schema and not table:
        schema, table = None, schema
    return schema, table, field, None if field == "*" else alias


def match_table(text: str) -> tuple[str | None, str, str | None]:
    m = _TABLE.fullmatch(text.strip())
    if not m:
        raise ValueError(f"{text!r} is not a table: [schema.]table [as alias]")
    return m[1], m[2], m[3]


def match_order(text: str) -> tuple[str | None, str | None, str, bool]:
    """(schema, table, field, descending); a sign wins over a word."""
    m = _ORDER.fullmatch(text.strip())
    if not m:
        raise ValueError(f"{text!r} is not a sort column: [+-][schema.][table.]field [asc|desc]")
    sign, schema, table, field, word = m.groups()
    if schema and not table:
        schema, table = None, schema
    descending = sign == "-" if sign else (word or "").lower().startswith("d")
    return schema, table, field, descending


def match_key(text: str) -> tuple[str, bool, str]:
    """(column, is an array, operator) of a filter's key."""
    m = _KEY.fullmatch(text.strip())
    if not m:
        raise ValueError(f"{text!r} is not a filter key: column[[]] [operator]")
    return m[1], bool(m[2]), (m[3] or "").strip()


def is_node(x: Any) -> bool:
    return isinstance(x, Node)
