"""The result layer."""

from .rows import FieldInfo, FieldMap, named_fields, rename, renamed, shaped_rows

__all__ = ["FieldInfo", "FieldMap", "named_fields", "rename", "renamed", "shaped_rows"]
