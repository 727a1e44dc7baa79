"""Field projections: ``a, b.c, d(e, -f), +g`` as a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

_NAME = re.compile(r"\s*([+-])?\s*([A-Za-z_$][\w$]*)\s*")


@dataclass
class Item:
    sign: str = ""
    children: dict[str, Item] = field(default_factory=dict)


def parse(projection: str | list[str] | tuple[str, ...] | None, keep_case: bool = False) -> dict[str, Item]:
    """A path that is named as a whole overrides paths below it; names are lower-cased."""
    out: dict[str, Item] = {}
    for text in [projection] if isinstance(projection, str) else projection or []:
        end = _paths(text if keep_case else text.lower(), 0, out)
        if end != len(text):
            raise ValueError(f"{text!r} is not a projection")
    return out


def _paths(text: str, at: int, target: dict[str, Item]) -> int:
    """Comma-separated paths up to a closing bracket or the end."""
    while True:
        at = _path(text, at, target)
        if at < len(text) and text[at] == ",":
            at += 1
            continue
        return at


def _path(text: str, at: int, target: dict[str, Item]) -> int:
    m = _NAME.match(text, at)
    if not m:
        raise ValueError(f"{text!r} is not a projection")
    item = target.setdefault(m[2], Item())
    if m[1]:
        item.sign = m[1]
    at = m.end()
    dotted = at < len(text) and text[at] == "."
    at += dotted
    if at < len(text) and text[at] == "(":
        at = _paths(text, at + 1, item.children)
        if at >= len(text) or text[at] != ")":
            raise ValueError(f"{text!r} has an open bracket")
        at += 1
        while at < len(text) and text[at].isspace():
            at += 1
        return at
    if dotted:
        return _path(text, at, item.children)
    item.children = {}
    return at


def wanted(names: list[str], tree: dict[str, Item], exclusive: Any) -> list[str]:
    """Names to read of the declared ``names``: all but exclusive ones and ± the signed, if every top item is signed; else those listed."""
    by_default = all(item.sign for item in tree.values())
    out = []
    for name in names:
        item = tree.get(name.lower())
        if item is None:
            take = by_default and not exclusive(name)
        else:
            take = item.sign != "-"
        if take:
            out.append(name)
    return out
