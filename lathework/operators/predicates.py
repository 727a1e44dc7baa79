"""Conditions: comparisons, logical operators, and the plain-dict filter shorthand."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from .base import Node, match_key
from .elements import Field, Raw


class Condition(Node):
    """Anything that can stand in WHERE, ON or WHEN."""


class Comparison(Condition):
    """``left <symbol> right``. A string on the left names a column (``name[]`` an array column)."""

    kind = "comparison"
    operator, symbol = "", ""

    def __init__(self, left: str | Node, right: Any = None):
        self.left = Field(left) if isinstance(left, str) else left
        self.right = right

    @property
    def empty(self) -> bool:
        """Whether the condition vanishes from its query."""
        return False


def _comparison(name: str, operator: str, symbol: str, base: type = Comparison) -> type:
    return type(name, (base,), {"operator": operator, "symbol": symbol, "__doc__": f"``left {symbol} right``."})


Eq = _comparison("Eq", "eq", "=")
Ne = _comparison("Ne", "ne", "!=")
Gt = _comparison("Gt", "gt", ">")
Gte = _comparison("Gte", "gte", ">=")
Lt = _comparison("Lt", "lt", "<")
Lte = _comparison("Lte", "lte", "<=")
Is = _comparison("Is", "is", "is")
IsNot = _comparison("IsNot", "is_not", "is not")


class Like(Comparison):
    """Pattern match; the pattern is made a string."""

    operator, symbol = "like", "like"

    def __init__(self, left: str | Node, right: Any = None):
        super().__init__(left, right if isinstance(right, Node) or right is None else str(right))


NotLike = _comparison("NotLike", "not_like", "not like", Like)
ILike = _comparison("ILike", "ilike", "ilike", Like)
NotILike = _comparison("NotILike", "not_ilike", "not ilike", Like)


class In(Comparison):
    """Membership in a list or a sub-select; an empty list drops the condition."""

    operator, symbol = "in", "in"

    def __init__(self, left: str | Node, right: Any = None):
        plain = not isinstance(right, Node)
        super().__init__(left, list(right) if isinstance(right, (list, tuple, set, frozenset)) else [right] if plain else right)

    @property
    def empty(self) -> bool:
        return isinstance(self.right, list) and not self.right


NotIn = _comparison("NotIn", "not_in", "not in", In)


class Between(Comparison):
    """``left between a and b``; one bound stands for both, none drops the condition."""

    operator, symbol = "between", "between"

    def __init__(self, left: str | Node, *bounds: Any):
        if len(bounds) == 1 and isinstance(bounds[0], (list, tuple)):
            bounds = tuple(bounds[0])
        super().__init__(left, [*bounds, *bounds][:2])
        if len(bounds) >= 2:
            self.right = list(bounds[:2]) if bounds[1] is not None else [bounds[0], bounds[0]]

    @property
    def empty(self) -> bool:
        return not self.right


NotBetween = _comparison("NotBetween", "not_between", "not between", Between)


class Exists(Condition):
    """Whether a sub-select has a row."""

    kind = "exists"
    negated = False

    def __init__(self, query: Node):
        from .queries import Select

        if not isinstance(query, (Select, Raw)):
            raise TypeError("exists needs a Select or Raw")
        self.query = query


class NotExists(Exists):
    negated = True


class Not(Condition):
    kind = "not"

    def __init__(self, condition: Any):
        self.condition = next(iter(as_conditions([condition])))


class Logical(Condition):
    """Conditions under AND or OR. Falsy items are skipped, dicts are read as filters."""

    kind = "logical"
    word = ""

    def __init__(self, *conditions: Any):
        self.items: list[Node] = []
        self.add(*conditions)

    def add(self, *conditions: Any) -> Logical:
        self.items += as_conditions(conditions)
        return self


class And(Logical):
    word = "and"


class Or(Logical):
    word = "or"


#: Filter keys of each operator.
OPERATORS: dict[str, type] = {
    "": Eq, "eq": Eq, "=": Eq, "ne": Ne, "!=": Ne, "gt": Gt, ">": Gt, "gte": Gte, ">=": Gte, "lt": Lt, "<": Lt, "lte": Lte, "<=": Lte,
    "between": Between, "btw": Between, "notbetween": NotBetween, "nbtw": NotBetween, "!between": NotBetween, "!btw": NotBetween,
    "in": In, "notin": NotIn, "nin": NotIn, "!in": NotIn, "like": Like, "notlike": NotLike, "nlike": NotLike, "!like": NotLike,
    "ilike": ILike, "notilike": NotILike, "nilike": NotILike, "!ilike": NotILike, "is": Is, "isnot": IsNot, "!is": IsNot,
    "exists": Exists, "notexists": NotExists, "!exists": NotExists,
}


class Path(Node):
    """A dotted path of any depth, which an entity's reader turns into columns and links."""

    kind = "path"

    def __init__(self, text: str, is_array: bool = False):
        self.parts, self.is_array = text.split("."), is_array


def _left(column: str, is_array: bool) -> Node:
    return Field(column, is_array=is_array) if column.count(".") < 3 else Path(column, is_array)


def as_conditions(items: Iterable[Any]) -> list[Node]:
    out: list[Node] = []
    for item in items:
        if not item and not isinstance(item, Node):
            continue
        if isinstance(item, (Condition, Raw)):
            out.append(item)
        elif isinstance(item, Mapping):
            out += from_filter(item)
        else:
            raise TypeError(f"a condition, Raw or filter is needed, not {item!r}")
    return out


def from_filter(filter_: Mapping[str, Any]) -> list[Node]:
    """Conditions of ``{"column operator": value, "or": [...], "exists": Select}``."""
    out: list[Node] = []
    for key, value in filter_.items():
        word = key.strip().lower()
        if word in ("and", "or"):
            out.append((And if word == "and" else Or)(*(value if isinstance(value, (list, tuple)) else [value])))
        elif word == "not":
            out.append(Not(And(*(value if isinstance(value, (list, tuple)) else [value]))))
        elif word in ("exists", "notexists", "!exists"):
            out.append(OPERATORS[word](value))
        else:
            column, is_array, operator = match_key(key)
            kind = OPERATORS.get(operator.lower())
            if kind is None:
                raise ValueError(f'Unknown operator "{operator}"')
            out.append(kind(_left(column, is_array), value))
    return out
