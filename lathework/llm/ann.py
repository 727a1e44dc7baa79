"""Approximate nearest neighbours by inner product with an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a cell is a pair of codewords. A query
walks the pairs in order of summed distance (the negated inner product with the two codewords) with a
heap until the cells passed hold enough entries: a share of the index that is calibrated on the sample
so that 0.95 of the true neighbours are met (small where vectors cluster, large where they don't). Entries and probes meet by cell block (first
codeword, split by cell where a block is large), are scored on the original vectors in double precision
and give each query's best; the best of all blocks are the result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mixed, ready

#: Vectors on which the codebooks are fitted (about; those with the smallest hashes of their ids), at least 40 a codeword.
SAMPLE = 20_000
ROUNDS = 12
#: Entries of one block that are held and scored at once.
BLOCK = 8192


#: Share of true neighbours that the calibration on the sample must reach.
RECALL = 0.95


def default_codewords(n: int) -> int:
    """Words of either codebook: they grow with the root of the index, up to a million cells."""
    return int(min(1024, max(4, math.sqrt(n) / 3.5)))


def calibrated(sample: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, k: int) -> float:
    """Share of the index that a query must pass, in walking order, to meet RECALL of its neighbours.

    Measured on the sample: a query's nearest ``k`` of ``n`` stand for its nearest k * sample / n there.
    """
    near = max(1, math.ceil(k * len(sample) / max(n, 1)))
    if len(sample) <= near + 1:
        return 1.0
    h, share = left.shape[1], []
    i = np.argmin((left**2).sum(1)[None, :] - 2 * sample[:, :h] @ left.T, axis=1)
    j = np.argmin((right**2).sum(1)[None, :] - 2 * sample[:, h:] @ right.T, axis=1)
    for at in np.linspace(0, len(sample) - 1, min(len(sample), 160)).astype(int):
        q = sample[at]
        truth = sample @ q
        truth[at] = -np.inf
        near_by = (left @ q[:h])[i] + (right @ q[h:])[j]
        better = np.sort(-near_by)
        share += np.searchsorted(better, -near_by[np.argpartition(-truth, near)[:near]], side="right").tolist()
    return float(np.quantile(share, RECALL)) / len(sample)


def usable(column: str) -> Column:
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _codebook(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].astype(np.float64)
    for _ in range(ROUNDS):
        own = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray  # entries of each cell, left x right
    share: float  # of the entries that a query passes

    def __post_init__(self) -> None:
        """Parts of about BLOCK entries: neighbouring cells of a block share one, a cell that is larger has several of its own."""
        before = np.cumsum(self.counts, axis=1) - self.counts
        own = np.maximum(1, -(-self.counts // BLOCK))  # parts of a cell
        large = own > 1
        step = before // BLOCK
        new = np.diff(step, axis=1, prepend=step[:, :1]) > 0
        new |= large | np.roll(large, 1, axis=1)  # a large cell and the one after it begin parts
        new[:, :1] = False  # the first cell's is part 0 anyway
        spare = np.where(large, own - 1, 0)
        self.first_part = np.cumsum(new, axis=1) + np.cumsum(spare, axis=1) - spare
        self.parts = own

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        pick = lambda part, book: np.argmin((book**2).sum(1)[None, :] - 2 * part @ book.T, axis=1)
        return pick(x[:, :h], self.left), pick(x[:, h:], self.right)

    def walk(self, q: np.ndarray, most: int) -> list[tuple[int, int]]:
        """Cells by summed distance until they hold ``most`` entries; empty ones are passed over."""
        h = self.left.shape[1]
        a, b = -(self.left @ q[:h]), -(self.right @ q[h:])
        ia, ib = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b = a[ia].tolist(), b[ib].tolist()
        heap, out, got = [(a[0] + b[0], 0, 0)], [], 0
        while heap and got < most:
            _, i, j = heapq.heappop(heap)
            n = self.counts[ia[i], ib[j]]
            if n:
                out.append((ia[i], ib[j]))
                got += int(n)
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return out


def fit(vectors: DataFrame, n: int, k: int, codewords: int | None = None, sample: int = SAMPLE) -> Index:
    """Codebooks and the walked share from a bounded sample of ``vectors(id, v)``."""
    words = codewords or default_codewords(n)
    sample = max(sample, 40 * words)
    share = min(1.0, sample / max(n, 1))
    cut = F.lit(int(-(2**63) + share * (2**64 - 1))) if share < 1 else F.lit(2**63 - 1)
    rows = vectors.where(F.xxhash64("id") <= cut).select("id", "v").limit(2 * sample).toArrow()
    order = np.argsort(np.array(rows.column("id").to_pylist(), dtype=object), kind="stable") if rows.num_rows else []
    x = matrix(rows.column("v")).astype(np.float64)[order]
    h = x.shape[1] // 2
    left, right = _codebook(x[:, :h], words), _codebook(x[:, h:], words)
    return Index(left, right, np.zeros((len(left), len(right)), np.int64), calibrated(x, left, right, n, k))


def _best(scores: np.ndarray, ids: np.ndarray, entries: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best entries, ties to smaller ids, scored one by one so that equal vectors score alike."""
    at = np.flatnonzero((scores > -np.inf) & (ids != own))
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge - 1e-9 * max(1.0, abs(edge))]
    exact = (entries[at] * q).sum(1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


_MET = "block int, part int, query boolean, id long, v array<{kind}>, cells array<int>"


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, candidates: int | None = None, codewords: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``is_query`` holds.

    Candidates are all rows but those with the query's id. Vectors that are null, empty, zero, or hold null
    or non-finite numbers take no part, nor do those not of the commonest length, nor null ids. Rows that
    repeat id and vector count once. Of equal vectors only the ``k`` + 1 smallest ids can be among the
    nearest, so only those are indexed, which keeps copies from filling a block. Empty in, empty out.
    """
    spark = ready(vectors)
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # what holds the vectors as they are
    good = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), is_query.alias("q"))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = sizes[0][0]
    good = good.where(F.size("v") == dims).groupBy("id", "v").agg(F.max("q").alias("q"))
    good = materialize(good, "ann-vectors")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = good.select("id", "v").withColumn("_rank", rank).where(F.col("_rank") <= k + 1).drop("_rank")
    entries = materialize(entries, "ann-entries")
    n = entries.count()
    index = fit(entries, n, k, codewords)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = index.cells(matrix(batch.column("v")).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), batch.column("id"), batch.column("v")], names=["block", "cell", "id", "v"])

    placed = materialize(entries.mapInArrow(place, f"block int, cell int, id long, v array<{kind}>"), "ann-index")
    counts = np.zeros((len(index.left), len(index.right)), np.int64)
    for i, j, c in placed.groupBy("block", "cell").count().collect():  # at most codewords^2 rows
        counts[i, j] = c
    index = replace(index, counts=counts)
    most = candidates or max(4 * k, math.ceil(index.share * n))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v")).astype(np.float64)
            block, part, row, cells = [], [], [], []
            for r in range(len(x)):
                by: dict[tuple[int, int], list[int]] = {}
                for i, j in index.walk(x[r], most):
                    at = int(index.first_part[i, j])
                    for p in range(at, at + int(index.parts[i, j])):
                        by.setdefault((i, p), []).append(j)
                for (i, p), js in by.items():
                    block.append(i)
                    part.append(p)
                    row.append(r)
                    cells.append(js)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array([True] * len(row), pa.bool_()), batch.column("id").take(take), batch.column("v").take(take), pa.array(cells, pa.list_(pa.int32()))],
                names=["block", "part", "query", "id", "v", "cells"],
            )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, ids = (batch.column(c).to_numpy() for c in ("block", "cell", "id"))
            own = mixed(ids.view(np.uint64)) % index.parts[i, j].astype(np.uint64)
            at = index.first_part[i, j] + own.astype(np.int64)
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(j) + 1), pa.int32()), batch.column("cell"))
            columns = [batch.column("block"), pa.array(at, pa.int32()), pa.array(np.zeros(len(j), bool)), batch.column("id"), batch.column("v"), one]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "query", "id", "v", "cells"])

    held = placed.mapInArrow(dealt, _MET.format(kind=kind))
    probes = good.where("q").select("id", "v").mapInArrow(probe, _MET.format(kind=kind))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        ids, rows, cell = [], [], []
        entry: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, part, query, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "query", "id"))
            v, lists = matrix(batch.column("v")).astype(np.float64), batch.column("cells")
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(query.astype(int)) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(block)], strict=True):
                if key != (block[a], part[a]):
                    key, entry = (block[a], part[a]), None
                    ids, rows, cell = [], [], []
                if not query[a]:
                    ids.append(own[a:b])
                    rows.append(v[a:b])
                    cell.append(lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False))
                    continue
                if not ids:
                    continue
                if entry is None:
                    entry = np.concatenate(ids), np.concatenate(rows), np.concatenate(cell)
                for at in range(a, b, 128):
                    to = min(b, at + 128)
                    wanted = np.zeros((to - at, len(index.right)), bool)
                    wanted[np.repeat(np.arange(to - at), [len(x) for x in lists.slice(at, to - at).to_pylist()]), lists.slice(at, to - at).flatten().to_numpy(zero_copy_only=False)] = True
                    scores = np.where(wanted[:, entry[2]], v[at:to] @ entry[1].T, -np.inf)
                    out = [(_best(scores[r], entry[0], entry[1], v[at + r], own[at + r], k), own[at + r]) for r in range(to - at)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.full(len(f[0]), q) for f, q in out]), pa.int64()), pa.array(np.concatenate([f[0] for f, _ in out]), pa.int64()), pa.array(np.concatenate([f[1] for f, _ in out]), pa.float64())],
                        names=["query_id", "vec_id", "score"],
                    )

    met = held.unionByName(probes).repartition("block", "part").sortWithinPartitions("block", "part", "query")
    found = met.mapInArrow(score, "query_id long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
