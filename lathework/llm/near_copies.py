"""Near copies by exact Jaccard similarity of word shingles.

Candidates come from fingerprints of the shingle sets, linked by the caller's search (``simhash``: all
within three bits), and from MinHash for similar texts whose fingerprints are further apart: ``BANDS`` keys
of ``ROWS`` minima each, so that texts of similarity 0.8 share a key in 0.999 of all cases. A bucket compares
sketches (one byte of each of ``SKETCH`` minima) and keeps a spanning forest of the pairs that may be similar,
never all pairs. The groups that all links form together then get their texts, and every link inside a
group is decided by the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, docs_of, materialize, mixed, runs, text_bytes

SHINGLE = 5
#: Least Jaccard similarity of linked texts, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 6
SKETCH = 64
#: Equal sketch bytes below which a pair is no candidate; at similarity 0.8 four in 100,000 pairs have fewer.
SKETCH_LEAST = 37
_HASHES = 1 << 20  # hashes compared at once

_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_FOLD = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """Hashes of a lower-cased UTF-8 text's word shingles in turn; shorter texts are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    of = xxhash.xxh64_intdigest
    return [of(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS permutations of the hashes' upper halves."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), 2048):
        np.minimum(out, (upper[None, at : at + 2048] * _MULTIPLY + _ADD).min(1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    return mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD).sum(1, dtype=np.uint64) ^ _SALT, own=True)


def sketch(least: np.ndarray) -> np.ndarray:
    return least[:SKETCH].astype(np.uint8)


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of 0..n-1; ``near(a, rest)`` marks those of ``rest`` that are linked to ``a``."""
    rest, found = np.arange(n), []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = []
            for a in front.tolist():
                linked = near(a, rest)
                found += [(a, b) for b in rest[linked].tolist()]
                reached.append(rest[linked])
                rest = rest[~linked]
                if not len(rest):
                    break
            front = np.concatenate(reached)
    return found


def _alike(sketches: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda a, rest: (sketches[rest] == sketches[a]).sum(1) >= SKETCH_LEAST


def similar(sets: list[np.ndarray], sketches: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """``near`` of ``_forest`` by the shingle sets (sorted, not empty) themselves."""
    up, down = LEAST
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    alike = _alike(sketches)

    def near(a: int, rest: np.ndarray) -> np.ndarray:
        own = sets[a]
        low, high = np.minimum(size[rest], size[a]), np.maximum(size[rest], size[a])
        out = (low * down >= high * up) & alike(a, rest)
        left = np.flatnonzero(out)
        while len(left):
            many = max(1, int(np.searchsorted(np.cumsum(size[rest[left]]), _HASHES, side="right")))
            now, left = left[:many], left[many:]
            length = size[rest[now]]
            every = np.concatenate([sets[i] for i in rest[now].tolist()])
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            both = np.add.reduceat(hit, np.cumsum(length) - length, dtype=np.int64)
            out[now] = both * down >= (length + size[a] - both) * up
        return out

    return near


def _stretches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that no value of ``column`` stands in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy(zero_copy_only=False)
        if held and held[-1].column(column)[0].as_py() != int(key[0]):
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def with_sets(docs: DataFrame, id_col: str, text_col: str, bits: Callable[[np.ndarray], int]) -> DataFrame:
    """``(id, row, print, fp, keys, sketch)`` per row: hashes of id with text and of the shingle set, the set's ``bits``, band keys, sketch.

    A text without words has print 0 and no keys.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, row long, print long, fp long, keys binary, sketch binary"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            prints, fps, keys, sketches = [], [], [], []
            for text in docs_of(*text_bytes(part.column(text_col))):
                own = shingle_set(text)
                least = minima(own)
                prints.append(xxhash.xxh64_intdigest(own.tobytes(), 42) if len(own) else 0)
                fps.append(bits(own))
                keys.append(band_keys(least).tobytes() if len(own) else b"")
                sketches.append(sketch(least).tobytes())
            wide = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, fps)]
            columns = [part.column(id_col), part.column("row"), *wide, pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "row", "print", "fp", "keys", "sketch"])

    return docs.select(id_col, text_col, row_hash(id_col, text_col)).mapInArrow(kernel, schema)


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col).alias("row")


def linked_prints(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``(a, b)`` between ``prints(print, fp)`` whose fingerprints are equal or linked by ``links``."""
    own = prints.where("print <> 0").select("print", "fp")
    firsts = materialize(own.groupBy("fp").agg(F.min("print").alias("first")), "near-copies-fingerprints")
    equal = own.join(firsts, "fp").where("print <> first").select(F.col("first").alias("a"), F.col("print").alias("b"))
    a, b = (firsts.select(F.col("fp").alias(n), F.col("first").alias(f"{n}_first")) for n in "ab")
    return equal.unionByName(links(firsts.select("fp")).join(a, "a").join(b, "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b")))


def candidates(prints: DataFrame) -> DataFrame:
    """Spanning links ``(a, b)`` of each bucket of ``prints(print, keys, sketch)``, whose prints are distinct."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.binary_length(batch.column("keys")), 0))
            if batch.num_rows:
                key = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
                at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("print").take(at), batch.column("sketch").take(at)], names=["key", "print", "sketch"])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _stretches(batches, "key"):
            starts, ends = runs(table.column("key").to_numpy())
            several = np.flatnonzero(ends - starts > 1)
            if not len(several):
                continue
            own = table.column("print").to_numpy()
            a, b = [], []
            for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                links = _forest(e - s, _alike(_rows_of(table.column("sketch").slice(s, e - s))))
                a += [own[s + i] for i, _ in links]
                b += [own[s + j] for _, j in links]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    spread = prints.mapInArrow(keyed, "key long, print long, sketch binary")
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(bucket, "a long, b long")


def exact(members: DataFrame, text_col: str) -> DataFrame:
    """``(print, root)``: components of similar texts inside each ``group`` of ``members(group, print, sketch, text)``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lean() -> Iterator[pa.RecordBatch]:  # sets instead of texts, so that a group's texts are never held
            for part in chunks(batches, text_col):
                sets = [shingle_set(t).tobytes() for t in docs_of(*text_bytes(part.column(text_col)))]
                yield pa.RecordBatch.from_arrays([part.column("group"), part.column("print"), part.column("sketch"), pa.array(sets, pa.large_binary())], names=["group", "print", "sketch", "set"])

        for table in _stretches(lean(), "group"):
            for s, e in zip(*(x.tolist() for x in runs(table.column("group").to_numpy())), strict=True):
                part = table.slice(s, e - s)
                own, first = np.unique(part.column("print").to_numpy(), return_index=True)
                sets = [np.frombuffer(part.column("set")[i].as_buffer(), np.uint64) for i in first.tolist()]
                root = np.arange(len(own))
                for a, b in _forest(len(own), similar(sets, _rows_of(part.column("sketch"))[first])):
                    root[b] = root[a]  # links lead away from each tree's first member
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[root])], names=["print", "root"])

    return members.repartition("group").sortWithinPartitions("group").mapInArrow(kernel, "print long, root long")


def label(docs: DataFrame, id_col: str, text_col: str, bits: Callable[[np.ndarray], int], links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(root, low)`` per component of near copies with an id: its mark, and the smallest ``(id, row)`` of it.

    ``bits`` gives a shingle set's fingerprint, ``links`` the links ``(a, b)`` between distinct fingerprints ``fp``.
    """
    base = materialize(with_sets(docs, id_col, text_col, bits), "near-copies")
    prints = base.groupBy("print").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("sketch").alias("sketch"))
    found = linked_prints(prints, links).unionByName(candidates(prints.select("print", "keys", "sketch")))
    groups = components(found, "near-copies-links").select(F.col("node").alias("print"), F.col("root").alias("group"))
    chosen = prints.select("print", "row", "sketch").join(groups, "print")
    members = docs.select(row_hash(id_col, text_col), F.col(text_col).alias("_text")).join(chosen, "row").select("group", "print", "sketch", "_text")
    roots = materialize(exact(members, "_text"), "near-copies-roots")
    lows = base.where(F.col(id_col).isNotNull()).groupBy("print").agg(F.min(F.struct(F.col(id_col).alias("id"), "row")).alias("low"))
    return lows.join(roots, "print", "left").groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("low").alias("low"))
