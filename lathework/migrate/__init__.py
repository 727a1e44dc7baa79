"""Versioned migrations."""

from .package import FunctionTask, InsertTask, Migration, Package, SqlTask, load
from .runner import MigrationError, Migrator, migrate, statements, substitute

__all__ = ["FunctionTask", "InsertTask", "Migration", "MigrationError", "Migrator", "Package", "SqlTask", "load", "migrate", "statements", "substitute"]
