"""SQL text of queries, for several dialects, with hooks and registered extensions."""

from .dialects import WRITERS, generate
from .writer import Extension, Generated, Writer, register, registered, unregister

__all__ = ["WRITERS", "Extension", "Generated", "Writer", "generate", "register", "registered", "unregister"]
