"""Compiling queries to Spark plans."""

from .compiler import Compiler, QueryError, Scope, literal

__all__ = ["Compiler", "QueryError", "Scope", "literal"]
