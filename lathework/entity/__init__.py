"""Entities: declared columns, embedded objects and links, read and written through repositories."""

from .model import (
    Column, Embedded, Index, Link, Meta, ModelError, after_destroy, after_insert, after_update, before_destroy, before_insert, before_update, column, embedded, entity, keys_of, link, meta_of,
    mixin, omit, pick, primary_key, union,
)
from .repository import BaseEntity, Repository

__all__ = [n for n in dir() if n[0] != "_"]
