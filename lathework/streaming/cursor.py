"""Reading a result row by row: a forward cursor with an optional cache, and streams of its rows.

Rows come by ``toLocalIterator``, a partition ahead at most, so a result of any size can be read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame

from ..functions.rows import FieldMap


class Cursor:
    """Position 0 is before the first row; rows count from 1; past the end the row is None."""

    def __init__(self, df: DataFrame, fields: FieldMap, shape: Callable[[list], list], prefetch: int = 100, on_close: Callable[[], None] | None = None):
        self.df, self.fields, self.prefetch = df, fields, max(prefetch, 1)
        self._shape, self._on_close = shape, on_close
        self._source: Iterator | None = None
        self._buffer: list[Any] = []
        self._cache: list[Any] | None = None
        self._fetched = 0
        self._position = 0
        self._row: Any = None
        self._at_end = False
        self.closed = False
        self.listeners: dict[str, list[Callable]] = {}

    # -- state

    row = property(lambda self: self._row)
    row_num = property(lambda self: self._position)
    fetched_rows = property(lambda self: self._fetched)
    is_bof = property(lambda self: self._position == 0)
    is_eof = property(lambda self: self._at_end)

    def on(self, event: str, listener: Callable) -> Cursor:
        """Listen to fetch, move, eof, reset, error or close."""
        self.listeners.setdefault(event, []).append(listener)
        return self

    def _emit(self, event: str, *args: Any) -> None:
        for listener in list(self.listeners.get(event, ())):
            listener(*args)

    def cached(self) -> Cursor:
        """Keep rows, so that the cursor can move back; only before the first fetch."""
        if self._fetched:
            raise RuntimeError("cache can be enabled only before fetching")
        self._cache = []
        return self

    # -- moving

    def _pull(self) -> Any:
        """The next row of the source, or None at its end."""
        if not self._buffer:
            if self._source is None:
                self._source = self.df.toLocalIterator(prefetchPartitions=True)
            got = list(islice(self._source, self.prefetch))
            if not got:
                return None
            self._buffer = self._shape(got)[::-1]
            self._fetched += len(got)
            self._emit("fetch", self._buffer[::-1])
        row = self._buffer.pop()
        if self._cache is not None:
            self._cache.append(row)
        return row

    def move_to(self, row_num: int) -> Any:
        if row_num < self._position and self._cache is None:
            raise RuntimeError("only a cached cursor can move back")
        if self.closed and self._cache is None:
            return None
        target = max(row_num, 0)
        if target == self._position:
            return self._row
        if self._cache is not None and target <= len(self._cache):
            self._position, self._at_end = target, False
            self._row = self._cache[target - 1] if target else None
        else:
            if self._cache is not None:
                self._position = len(self._cache)
            while self._position < target and not self._at_end:
                row = self._pull()
                self._position += 1
                self._row = row
                if row is None:
                    self._at_end = True
        if self._at_end:
            self._emit("eof")
            if self._cache is None:
                self.close()
        else:
            self._emit("move", self._row, self._position)
        return self._row

    def next(self) -> Any:
        return self._row if self._at_end else self.move_to(self._position + 1)

    def prev(self) -> Any:
        return self.move_to(self._position - 1)

    def seek(self, step: int) -> Any:
        return self.move_to(self._position + step) if step else self._row

    def reset(self) -> None:
        if self._cache is None:
            raise RuntimeError("only a cached cursor can be reset")
        self._position, self._row, self._at_end = 0, None, False
        self._emit("reset")

    def fetch_all(self) -> list[Any]:
        """All rows from here to the end."""
        out = []
        if self._cache is not None:
            out, self._position = self._cache[self._position :], len(self._cache)
        while (row := self._pull()) is not None:
            out.append(row)
            self._position += 1
        self._position, self._row, self._at_end = self._position + 1, None, True
        self._emit("eof")
        if self._cache is None:
            self.close()
        return out

    def __iter__(self) -> Iterator[Any]:
        while (row := self.next()) is not None:
            yield row

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self._source = None
            if self._on_close:
                self._on_close()
            self._emit("close")

    def to_stream(self, objects: bool = False, limit: int | None = None) -> Iterator[Any]:
        """Rows one by one, or as the pieces of a JSON array's text."""
        rows = self if limit is None else islice(self, limit)
        if objects:
            yield from rows
            return
        yield "["
        for i, row in enumerate(rows):
            yield ("," if i else "") + json.dumps(row, default=str, ensure_ascii=False)
        yield "]"
        self.close()
