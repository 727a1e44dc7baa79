"""Bringing what was found about documents back to their texts, in one exchange.

A document is known by its id (nulls last) and a hash of its text; by that hash it belongs to one of
many groups of a bounded share of the corpus. A task that found something about documents sends one row
per group, with all its findings packed; texts are dealt by group too and stream through, findings first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, runs, text_bytes

NO_ID = 2**63 - 1
#: Text bytes that one group stands for.
GROUP = 8 << 20
_ROWS = 2048

FOUND = "group int, found binary"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id long, key long, text string)``; null ids become NO_ID, null texts empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def groups_for(total_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / GROUP))


def packed(ids: np.ndarray, keys: np.ndarray, values: np.ndarray, groups: int) -> pa.RecordBatch:
    """Rows ``(group, found)``. Values are 32-bit numbers of the documents given beside them, in any order."""
    group = np.mod(keys, groups)
    order = np.lexsort((keys, ids, group))
    ids, keys, group, values = ids[order], keys[order], group[order], values[order].astype(np.uint32)
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))) if len(ids) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(ids)))
    starts, ends = runs(group[new])
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        n = b - a
        lo, hi = new[a], new[b] if b < len(new) else len(ids)
        out.append(b"".join((np.int64(n).tobytes(), ids[new[a:b]].tobytes(), keys[new[a:b]].tobytes(), sizes[a:b].astype(np.int64).tobytes(), values[lo:hi].tobytes())))
    return pa.RecordBatch.from_arrays([pa.array(group[new][starts], pa.int32()), pa.array(out, pa.binary())], names=["group", "found"])


def _unpacked(blob: bytes) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    ids, keys, sizes = np.frombuffer(blob, np.int64, 3 * n, 8).reshape(3, n)
    at = 8 + 24 * n
    for i, k, s in zip(ids.tolist(), keys.tolist(), sizes.tolist(), strict=True):
        yield (i, k), np.frombuffer(blob, np.uint32, s, at)
        at += 4 * s


def sides(texts: DataFrame, findings: DataFrame, groups: int) -> DataFrame:
    """Texts of ``keyed`` and findings, dealt by group, a group's findings first."""
    own = texts.select(F.pmod("key", F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("side"), "id", "key", F.col("text").cast("binary").alias("value"))
    other = findings.select("group", F.lit(0).alias("side"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("key"), F.col("found").alias("value"))
    return dealt(own.unionByName(other), "group", groups).sortWithinPartitions("group", "side")


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, list[np.ndarray]]]:
    """(id, key, text, findings) of every text row that ``sides`` brings."""
    now: int | None = None
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        group, side, ids, keys = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(4))
        raw, off = text_bytes(batch.column(4))
        view, off = memoryview(raw), off.tolist()
        for i in range(batch.num_rows):
            if group[i] != now:
                now, found = group[i], {}
            value = bytes(view[off[i] : off[i + 1]])
            if side[i] == 0:
                for key, values in _unpacked(value):
                    found.setdefault(key, []).append(values)
            else:
                yield ids[i], keys[i], value, found.get((ids[i], keys[i]), [])


def meet(texts: DataFrame, findings: DataFrame, groups: int, finish: Callable[[bytes, list[np.ndarray]], tuple], schema: str, id_col: str) -> DataFrame:
    """``finish(text, findings)`` for every text row; ``schema`` names and types what it returns, after the id.

    Rows that repeat an id and a text get the same findings.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(own: list, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *[pa.array(c) for c in zip(*rows, strict=True)]], names=[id_col, *names])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = [], []
        for id_, _, text, found in documents(batches):
            own.append(None if id_ == NO_ID else id_)
            rows.append(finish(text, found))
            if len(rows) == _ROWS:
                yield batch_of(own, rows)
                own, rows = [], []
        if rows:
            yield batch_of(own, rows)

    return sides(texts, findings, groups).mapInArrow(kernel, f"{id_col} long, {schema}")
