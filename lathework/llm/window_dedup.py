"""Substring dedup by Rabin-Karp hashes of every window of consecutive words.

Map tasks hash all windows of a chunk of documents and keep each distinct one's earliest start (later
starts in the chunk are removed already). Hashes go to buckets by their leading bits in blocks of
bytes of equal weight, so one window costs some eight bytes of shuffle and a frequent one a single entry per chunk.
A bucket's task counts equal hashes and marks all starts but the earliest. Marked windows meet their
document again, where they merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meeting
from .common import dealt, gathered, mixed, ready, runs, spread, text_bytes

WINDOW = 20
#: Text bytes hashed at once by a map task, and text bytes that one hash bucket stands for.
CHUNK, BUCKET = 3 << 20, 16 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i up to n, modulo 2^64; the longest table of each base is kept."""
    if base not in _tables or len(_tables[base][0]) <= n:
        size = (n >> 20) + 1 << 20
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _tables[base] = np.cumprod(up, out=up), np.cumprod(down, out=down)
    return _tables[base]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2^64) of the stretches values[start:end], from one pass of prefix sums."""
    up, down = _powers(base, len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def rolling_all(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """``rolling`` for every stretch of ``width`` values, by slices instead of lookups."""
    n = len(values)
    up, down = _powers(base, n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=prefix[1:])
    out = prefix[width:] - prefix[:-width]
    out *= down[: len(out)]
    return out


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hashes of all words of the texts in a byte view, and the first word's number of each text."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~_BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1][(off[:-1] < len(raw))]
    first[edge] |= inside[edge]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] |= inside[edge]
    ends = np.flatnonzero(last) + 1
    hashes = rolling(raw.astype(np.uint64) + np.uint64(1), starts, ends, _BYTE_BASE)
    return mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, off)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed(docs: np.ndarray) -> bytes:
    """Rows (id, key, first start) column by column, so that near numbers compress."""
    return b"".join(_planes(np.ascontiguousarray(docs[:, i])) for i in range(3))


def _places(starts: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, key, offset) of a block's starts."""
    n = len(docs) // 3
    table = np.stack([_from_planes(docs[i * n : i * n + n], np.int64) for i in range(3)], 1)
    return _located(np.cumsum(_from_planes(starts, np.uint32).astype(np.int64)), table)


_SENT = "bucket int, hashes binary, starts binary, docs binary"


def _located(starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, key, offset) of word numbers; ``docs`` has rows (id, key, first word's number)."""
    own = np.searchsorted(docs[:, 2], starts, side="right") - 1
    return docs[own, 0], docs[own, 1], starts - docs[own, 2]


#: Hashes of a chunk of texts: (hash, start) by ascending start, and the texts' first starts.
Hashing = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: How a long text is cut into pieces (begin, end, number of its first start), none of whose windows is lost.
Cutting = Callable[[np.ndarray, int], list[tuple[int, int, int]]]


def cut_words(window: int) -> Cutting:
    """Cuts at blanks about every ``most`` bytes; each piece begins with the last window - 1 words of the one before."""

    def of(raw: np.ndarray, most: int) -> list[tuple[int, int, int]]:
        inside = ~_BLANK[raw]
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        ends = [int(np.searchsorted(starts, at)) for at in range(most, len(raw), most)]
        words = np.unique([*[e for e in ends if e < len(starts)], len(starts)])
        out, before = [], 0
        for e in words.tolist():
            first = max(0, before - window + 1)
            out.append((int(starts[first]) if first < len(starts) else 0, int(starts[e]) if e < len(starts) else len(raw), first))
            before = e
        return out

    return of


def windows(window: int) -> Hashing:
    def of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, first = word_hashes(raw, off)
        starts = spread(first[:-1], np.maximum(np.diff(first) - window + 1, 0))
        if not len(starts):
            return np.zeros(0, np.uint64), starts, first[:-1]
        return mixed(rolling_all(words, window, _WORD_BASE)[starts]), starts, first[:-1]

    return of


def hashed(texts: DataFrame, of: Hashing, cut: Cutting, buckets: int, every: bool, chunk: int = CHUNK) -> DataFrame:
    """Each chunk's distinct hashes by bucket, and its own repeated starts under a negative bucket.

    Repeated are the starts of an equal hash but the earliest, or all of them if ``every``. Texts of more
    than two chunks are cut.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Chunks: (ids, keys, bytes, offsets, number of the first start)."""
        for part in gathered(batches, "text", chunk):
            ids, keys = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            order = np.lexsort((keys, ids))
            ids, keys = ids[order], keys[order]
            once = np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))  # repeated rows are one document
            raw, off = text_bytes(part.column("text").take(pa.array(order[once])))
            if len(off) == 2 and len(raw) > 2 * chunk:
                for begin, end, first in cut(raw, chunk):
                    yield ids[once], keys[once], raw[begin:end], np.array([0, end - begin]), first
            else:
                yield ids[once], keys[once], raw, off, 0

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, raw, off, begun in parts(batches):
            hashes, starts, first = of(raw, off)
            if not len(starts):
                continue
            docs = np.stack((ids, keys, first - begun), 1)
            by = np.argsort(hashes)
            a, b = runs(hashes[by])
            sent = np.zeros(len(hashes), bool)
            sent[np.minimum.reduceat(by, a)] = True  # the earliest of equal hashes
            again = np.sort(starts[by[np.repeat(b - a > 1, b - a)]]) if every else starts[~sent]
            hashes, starts = hashes[sent], starts[sent]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            hashes, starts, bucket = hashes[order], starts[order], bucket[order]
            out: list[tuple[int, bytes, bytes, bytes]] = []
            for i, j in zip(*(x.tolist() for x in runs(bucket)), strict=True):
                used = np.unique(np.searchsorted(first, starts[i:j], side="right") - 1)
                out.append((int(bucket[i]), _planes(hashes[i:j])[: 7 * (j - i)], _planes(np.diff(starts[i:j], prepend=0).astype(np.uint32)), _packed(docs[used])))
            if len(again):
                used = np.unique(np.searchsorted(first, again, side="right") - 1)
                out.append((-1 - int(hashes[0] % np.uint64(buckets)), b"", _planes(np.diff(again, prepend=0).astype(np.uint32)), _packed(docs[used])))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(x, pa.binary()) for x in columns[1:]]], names=["bucket", "hashes", "starts", "docs"])

    return texts.mapInArrow(kernel, _SENT)


def _repeated(held: list[tuple[bytes, bytes, bytes]], every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, key, offset) of a bucket's starts whose hash also starts earlier, or elsewhere if ``every``."""
    # seven bytes of each hash travel: the eighth is the bucket's but for some bits
    hashes = np.concatenate([_from_planes(h + bytes(len(h) // 7), np.uint64) for h, _, _ in held])
    by = np.argsort(hashes)
    a, b = runs(hashes[by])
    many = b - a > 1
    at = by[spread(a[many], (b - a)[many])]
    group = np.repeat(np.arange(int(many.sum())), (b - a)[many])
    places = [_places(s, d) for _, s, d in held]
    ids, keys, offsets = (np.concatenate([p[i] for p in places])[at] for i in range(3))
    order = np.lexsort((offsets, keys, ids, group))
    ids, keys, offsets, group = ids[order], keys[order], offsets[order], group[order]
    starts, ends = runs(group)
    low = np.repeat(starts, ends - starts)
    later = (ids != ids[low]) | (keys != keys[low]) | (offsets != offsets[low])
    if every:
        later = np.repeat(np.logical_or.reduceat(later, starts), ends - starts) if len(later) else later
    return ids[later], keys[later], offsets[later]


def counted(sent: DataFrame, buckets: int, every: bool, groups: int) -> DataFrame:
    """Findings for ``meeting``: offsets of the repeated starts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[tuple[bytes, bytes, bytes]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, hashes, starts, docs = (c[i].as_py() for c in batch.columns)
                if bucket != now and held:
                    yield meeting.packed(*_repeated(held, every), groups)
                    held = []
                now = bucket
                if bucket < 0:
                    yield meeting.packed(*_places(starts, docs), groups)
                else:
                    held.append((hashes, starts, docs))
        if held:
            yield meeting.packed(*_repeated(held, every), groups)

    return dealt(sent, "bucket", buckets).sortWithinPartitions("bucket").mapInArrow(kernel, meeting.FOUND)


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``id, n_words, n_removed, kept_sha256``.

    A word goes if it lies in a window of ``window`` words whose sequence also starts earlier, in a smaller
    id or further up in the same document. Null texts have no words; texts shorter than a window lose
    none. Null ids count as the largest. Rows that repeat id and text are one document and get the same
    result each; one id with several texts is several documents, ordered by a hash of the text. Windows
    are told apart by 56 bits of hash inside a bucket of some millions. Extra columns are ignored.
    """
    ready(docs)
    texts = meeting.keyed(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = meeting.groups_for(total)
    buckets = max(1, math.ceil(total / BUCKET))
    found = counted(hashed(texts, windows(window), cut_words(window), buckets, False, chunk), buckets, False, groups)

    def finish(text: bytes, findings: list[np.ndarray]) -> tuple[int, int, str]:
        words = text.split()
        if not findings:
            return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
        cover = np.zeros(len(words) + 1, np.int64)
        for at in findings:
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
        keep = np.cumsum(cover[:-1]) == 0
        return len(words), int(len(words) - keep.sum()), hashlib.sha256(b" ".join(compress(words, keep.tolist()))).hexdigest()

    return meeting.meet(texts, found, groups, finish, "n_words long, n_removed long, kept_sha256 string", id_col)
