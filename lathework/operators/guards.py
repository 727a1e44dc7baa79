"""Telling query objects apart."""

from __future__ import annotations

from . import base, elements, predicates, queries


def _guard(*kinds: type):
    return lambda x: isinstance(x, kinds)


is_node = _guard(base.Node)
is_query = _guard(queries.Query)
is_select, is_union = _guard(queries.Select), _guard(queries.Union)
is_insert, is_update, is_delete = _guard(queries.Insert), _guard(queries.Update), _guard(queries.Delete)
is_raw, is_field, is_table, is_param = _guard(elements.Raw), _guard(elements.Field), _guard(elements.Table), _guard(elements.Param)
is_join, is_case, is_sequence = _guard(elements.Join), _guard(elements.Case), _guard(elements.Sequence)
is_group_column, is_order_column, is_returning_column = _guard(elements.GroupColumn), _guard(elements.OrderColumn), _guard(elements.ReturningColumn)
is_condition, is_comparison, is_logical, is_not, is_exists = _guard(predicates.Condition), _guard(predicates.Comparison), _guard(predicates.Logical), _guard(predicates.Not), _guard(predicates.Exists)
is_aggregate = _guard(elements.Count, elements.Max, elements.Min, elements.StringAgg)

