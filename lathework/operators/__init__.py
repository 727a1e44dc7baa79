"""The query language: columns, expressions, conditions, joins and queries."""

from .base import Aliased, Node
from .elements import (
    Call, Case, Coalesce, Count, CrossJoin, Field, FullOuterJoin, GroupColumn, InnerJoin, Join, LeftJoin, LeftOuterJoin, Lower, Max, Min, OrderColumn, OuterJoin, Param, Raw,
    ReturningColumn, RightJoin, RightOuterJoin, Sequence, StringAgg, Table, Upper,
)
from .predicates import (
    And, Between, Comparison, Condition, Eq, Exists, Gt, Gte, ILike, In, Is, IsNot, Like, Logical, Lt, Lte, Ne, Not, NotBetween, NotExists, NotILike, NotIn, NotLike, Or,
)
from .queries import Delete, Insert, Query, Select, Union, Update
from .types import DataType

__all__ = [n for n in dir() if n[0].isupper()]
