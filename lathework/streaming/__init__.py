"""Row-by-row reading of results."""

from .cursor import Cursor

__all__ = ["Cursor"]
