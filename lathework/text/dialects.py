"""Writers of the dialects: spark, postgres, oracle, sqlite and mssql."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from ..operators import base, elements, predicates, queries
from .writer import Generated, Writer


def _list(x: Any) -> bool:
    return isinstance(x, (list, tuple, set, frozenset))


class SqliteWriter(Writer):
    dialect = "sqlite"

    def paged(self, n: queries.Select, body: str, limit: int, offset: int) -> str:
        page = " ".join(x for x in (f"LIMIT {limit}" if limit else "", f"OFFSET {offset}" if offset else "") if x)
        return self.lines(body, page)

    def _returned(self, n: Any) -> str:
        super()._returned(n)  # the columns are noted, but the text has no such clause
        return ""


class PostgresWriter(Writer):
    dialect = "postgres"
    null_rule = True
    reserved = frozenset({"comment"})
    paged = SqliteWriter.paged

    def __init__(self, *args: Any, **options: Any):
        super().__init__(*args, **options)
        self.bound, self.options = [], []

    def placeholder(self, name: str, value: Any, node: elements.Param) -> str:
        self.bound.append(value)
        self.options.append({"data_type": node.data_type, "is_array": node.is_array})
        return f"${len(self.bound)}"

    def compared(self, n: predicates.Comparison, left: str, right: Any, value: Any) -> str:
        if n.operator in ("in", "not_in") and isinstance(right, elements.Param):
            no = "not " if n.operator == "not_in" else ""
            many = _list(value) or right.is_array
            array = isinstance(n.left, elements.Field) and n.left.is_array
            text = self.value(right)
            if array and many:
                return f"{no}{left} && {text}"
            if array:
                return f"{no}{text} = ANY({left})"
            if many:
                return f"{left} = ANY({text})" if not no else f"{left} != ALL({text})"
            return f"{left} {n.symbol} {text}"
        return super().compared(n, left, right, value)


class OracleWriter(Writer):
    dialect = "oracle"
    null_rule = True
    reserved = frozenset({"comment"})

    def string(self, x: str) -> str:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", x):
            return f"to_date('{x}', 'yyyy-mm-dd')"
        if re.match(r"\d{4}-\d{2}-\d{2}T", x):
            return f"""to_timestamp_tz('{x}','yyyy-mm-dd"T"hh24:mi:sstzh:tzm')"""
        return super().string(x)

    def date(self, x: dt.date) -> str:
        text = super().date(x)
        return f"to_date({text}, 'yyyy-mm-dd{' hh24:mi:ss' if len(text) > 12 else ''}')"

    def boolean(self, x: bool) -> str:
        return "1" if x else "0"

    def compared(self, n: predicates.Comparison, left: str, right: Any, value: Any) -> str:
        if isinstance(right, elements.Param) and _list(value):
            word = {"eq": "in", "ne": "not in"}.get(n.operator, n.symbol)
            return f"{left} {word} {self.value(list(value))}"
        return super().compared(n, left, right, value)

    def placeholder(self, name: str, value: Any, node: elements.Param) -> str:
        text = super().placeholder(name, value, node)
        if isinstance(value, dt.datetime) and isinstance(self.root, (queries.Select, queries.Delete)):
            self.bound[name] = f"{value:%Y-%m-%d %H:%M:%S}"
            return f"TO_DATE({text}, 'yyyy-mm-dd hh24:mi:ss.SSSSS')"
        return text

    def _from(self, n: queries.Select) -> str:
        return super()._from(n) or "from dual"

    def hint(self, n: queries.Select) -> str:
        out = ""
        for t in n.tables:
            own = [h for d, h in getattr(t, "hints", []) if d in (None, self.dialect)]
            if own:
                out += "/*+ " + re.sub(":table", t.alias or t.name, "\n".join(own), flags=re.I) + " */"
        return out

    def paged(self, n: queries.Select, body: str, limit: int, offset: int) -> str:
        if not limit and not offset:
            return body
        if self.version and int(self.version.split(".")[0]) >= 12:
            if offset:
                return self.lines(body, f"OFFSET {offset} ROWS" + (f" FETCH NEXT {limit} ROWS ONLY" if limit else ""))
            return self.lines(body, f"FETCH FIRST {limit} ROWS ONLY")
        if not offset and not n.order:
            return f"select * from ({body}) where rownum <= {limit}"
        inner = f"select /*+ first_rows({limit or 100}) */ t.*, rownum row$number from ({body}) t" + (f" where rownum <= {limit + offset}" if limit else "")
        return f"select * from ({inner})" + (f" where row$number >= {offset + 1}" if offset else "")

    def _string_agg(self, n: elements.StringAgg) -> str:
        order = ", ".join(self.write(o) for o in n.order) or "null"
        return self._with_alias(f"listagg({self.value(n.field)},{self.string(n.separator)}) within group (order by {order})", n.alias)

    def _sequence(self, n: elements.Sequence) -> str:
        return self._with_alias(f"{n.name}.{'nextval' if n.advance else 'currval'}", n.alias)

    def _returned(self, n: Any) -> str:
        super()._returned(n)
        return ""


class MssqlWriter(Writer):
    dialect = "mssql"
    reserved = frozenset({"comment"})

    def placeholder(self, name: str, value: Any, node: elements.Param) -> str:
        super().placeholder(name, value, node)
        return f"@{name}"

    def paged(self, n: queries.Select, body: str, limit: int, offset: int) -> str:
        page = " ".join(x for x in (f"OFFSET {offset} ROWS" if offset else "", f"FETCH NEXT {limit} ROWS ONLY" if limit else "") if x)
        return self.lines(body, page)


class SparkWriter(Writer):
    """Text that ``spark.sql`` runs, with named arguments; lists are written out, as arguments can't hold them in IN."""

    dialect = "spark"
    null_rule = True
    paged = SqliteWriter.paged
    _HINTS = frozenset("broadcast broadcastjoin mapjoin merge shuffle_merge mergejoin shuffle_hash shuffle_replicate_nl coalesce repartition repartition_by_range rebalance".split())

    def string(self, x: str) -> str:
        return super().string(x.replace("\\", "\\\\"))

    def quoted(self, word: str) -> str:
        return f"`{word}`"

    def date(self, x: dt.date) -> str:
        text = super().date(x)
        if not isinstance(x, dt.datetime):
            return f"date{text}"
        return f"timestamp'{x.astimezone(dt.timezone.utc):%Y-%m-%d %H:%M:%S.%f}+00:00'" if x.tzinfo else f"timestamp_ntz'{x:%Y-%m-%d %H:%M:%S.%f}'"

    def compared(self, n: predicates.Comparison, left: str, right: Any, value: Any) -> str:
        array = isinstance(n.left, elements.Field) and n.left.is_array
        if array and n.operator in ("in", "not_in") and not isinstance(value, base.Node):
            no = "not " if n.operator == "not_in" else ""
            if _list(value):
                return f"{no}arrays_overlap({left}, array({', '.join(self.value(v) for v in value)}))"
            return f"{no}array_contains({left}, {self.value(value)})"
        if _list(value) and n.operator in ("eq", "ne", "in", "not_in"):
            if not value:
                return ""
            return f"{left} {'in' if n.operator in ('eq', 'in') else 'not in'} {self.value(list(value))}"
        if n.operator in ("is", "is_not") and value is not None and not isinstance(right, base.Node):
            return f"{'not ' if n.operator == 'is_not' else ''}{left} <=> {self.value(right)}"
        return super().compared(n, left, right, value)

    def _string_agg(self, n: elements.StringAgg) -> str:
        order = f" within group (order by {', '.join(self.write(o) for o in n.order)})" if n.order else ""
        return self._with_alias(f"listagg({self.value(n.field)}, {self.string(n.separator)}){order}", n.alias)

    def _order_column(self, n: elements.OrderColumn) -> str:
        return self.path(n.schema, n.table, n.name) + (" desc nulls first" if n.descending else " asc nulls last")

    def _join(self, n: elements.Join) -> str:
        text = super()._join(n)
        return "full " + text if n.how == "outer" else text

    def _union(self, n: queries.Union) -> str:
        return self.lines(*[x for i, q in enumerate(n.queries) for x in ([f"union{' all' if n.all else ''}"] if i else []) + [f"({self.write(q)})"]])

    def hint(self, n: queries.Select) -> str:
        own = [h for t in n.tables for d, h in getattr(t, "hints", []) if d in (None, self.dialect) and h.split("(")[0].strip().lower() in self._HINTS]
        return f"/*+ {', '.join(own)} */" if own else ""

    def inserted(self, n: queries.Insert, values: str, gap: str) -> str:
        return super().inserted(n, values, gap) if isinstance(n.source, dict) else values


WRITERS = {w.dialect: w for w in (SparkWriter, PostgresWriter, OracleWriter, SqliteWriter, MssqlWriter)}


def generate(query: queries.Query, dialect: str | None = None, params: Any = None, strict_params: bool = False, pretty: bool = False, dialect_version: str | None = None) -> Generated:
    if dialect in WRITERS:
        writer = WRITERS[dialect](query, params, strict_params, pretty, dialect_version)
    else:
        writer = Writer(query, params, strict_params, pretty, dialect_version)
        writer.dialect = dialect
    return writer.generated()
