"""Substring dedup over bytes with suffix arrays that are built shard by shard.

Strings of ``LENGTH`` bytes are removed, those of ``REPORT`` bytes are reported as well: that is some 40 to
50 words, so that shared passages show that are too short to go. A repeated string begins with ``REPORT``
bytes that hold the same smallest hash of a short gram (their anchor) wherever they start, so strings are
dealt to shards by anchor. First the anchors of all documents are counted: a string whose anchor occurs once
can't be repeated. Documents with repeated anchors send the bytes around each, which cover all strings that
begin with what the anchor owns. A shard sorts the distinct pieces whose anchor another one shares with
Larsson-Sadakane refinement, takes common prefixes by Kasai's inequality and marks the strings that agree over
either length. Where a bucket holds several shards, their string classes are merged by binary search and
compared byte by byte. Marked strings meet their documents again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meeting, suffix
from .common import dealt, merged, mixed, ready, runs, spread
from .window_dedup import counted, hashed, rolling, rolling_all

LENGTH, REPORT, GRAM = 400, 240, 64
#: Bytes of pieces that one suffix array takes, text bytes that one bucket of pieces or of anchors stands
#: for, and bytes of texts whose pieces a task cuts at once.
SHARD, PIECES, ANCHORS, CHUNK = 1 << 20, 4 << 20, 96 << 20, 3 << 20
_BASE = 0xA0761D6478BD642F
#: Low bits of a gram's hash that give way to its place. The number is fixed, so equal strings have equal anchors in any chunk.
_PLACE = 24


def anchors(raw: np.ndarray, off: np.ndarray, length: int = REPORT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes inside the texts: (hash, place, first and last + 1 string start)."""
    none = np.zeros(0, np.int64)
    n = len(raw) - length + 1
    if n < 1 or np.diff(off).max() < length:
        return none.astype(np.uint64), none, none, none
    valid = np.ones(n, bool)  # starts whose string ends in the same text
    for first, end in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        valid[max(first, end - length + 1) : end] = False
    hashes = mixed(rolling_all(raw.astype(np.uint64), gram, _BASE), own=True)
    if len(hashes) >> _PLACE:
        raise ValueError(f"{len(raw)} bytes are too many for one chunk")
    bits = np.uint64(_PLACE)
    ranked = hashes >> bits
    ranked <<= bits
    ranked |= np.arange(len(hashes), dtype=np.uint64)  # the leftmost of equal hashes is the smallest
    span = length - gram + 1
    blocks = -(-len(ranked) // span)
    ranked = np.concatenate((ranked, np.full(blocks * span - len(ranked), ~np.uint64(0)))).reshape(blocks, span)
    ahead = np.minimum.accumulate(ranked, axis=1).ravel()
    behind = np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].ravel()
    place = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    place &= (np.uint64(1) << bits) - np.uint64(1)
    a = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]))))
    b = np.append(a[1:], n)
    a, b = a[valid[a]], b[valid[a]]
    at = place[a].astype(np.int64)
    return mixed(hashes[at] + np.uint64(1)), at, a, b  # smallest hashes lie near 0: spread them


def _anchor_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, place, _, _ = anchors(raw, off)
    return hashes, place, off[:-1]


def _cut_bytes(raw: np.ndarray, most: int, length: int = REPORT) -> list[tuple[int, int, int]]:
    """Pieces of a long text that overlap by all but one byte of a string, so that each string is in one."""
    return [(at, min(at + most + length - 1, len(raw)), at) for at in range(0, max(len(raw) - REPORT + 1, 1), most)]


_PIECES = "bucket int, data binary, meta binary"
_META = 6  # numbers of a piece: id, key, first string's offset, bytes, anchor, strings


def _covered(offset: int, strings: int, size: int) -> list[int]:
    """Findings if all strings of a piece are repeated: (start, end) to remove, (end, start) only to report."""
    long = min(strings, size - LENGTH + 1)
    out = [offset, offset + long + LENGTH - 1] if long > 0 else []
    return out if long == strings else [*out, offset + strings + REPORT - 1, offset]


def _pieces(texts: DataFrame, candidates: DataFrame, groups: int, buckets: int, chunk: int) -> DataFrame:
    """Pieces around repeated anchors by bucket; ``meta`` has rows of ``_META`` numbers.

    A piece has the strings of REPORT bytes that its anchor owns and, where the text goes on, what
    completes them to LENGTH bytes. Equal pieces of a chunk are sent once. Their strings are repeated for certain: those go as rows under
    a negative bucket, without data.
    """
    def cut(held: list[tuple[int, int, bytes, np.ndarray]], begun: int = 0, most: int | None = None) -> Iterator[pa.RecordBatch]:
        """Of texts, or of the ``most`` starts of one text from ``begun`` on; wanted places count from there."""
        raw = np.frombuffer(b"".join(t for _, _, t, _ in held), np.uint8)
        off = np.append(0, np.cumsum([len(t) for _, _, t, _ in held]))
        hashes, place, lo, hi = anchors(raw, off)
        wanted = np.isin(place, np.concatenate([c + o for (_, _, _, c), o in zip(held, off[:-1].tolist(), strict=True)]))
        if most is not None:
            wanted &= lo < most
            hi = np.minimum(hi, most)
        hashes, place, lo, hi = (x[wanted] for x in (hashes, place, lo, hi))
        doc = np.searchsorted(off, lo, side="right") - 1
        ends = np.minimum(hi + LENGTH - 1, off[doc + 1])
        meta = np.stack((np.array([h[0] for h in held], np.int64)[doc], np.array([h[1] for h in held], np.int64)[doc], lo - off[doc] + begun, ends - lo, hashes.view(np.int64), hi - lo), 1)
        data = [raw[a:b].tobytes() for a, b in zip(lo.tolist(), ends.tolist(), strict=True)]
        first: dict[tuple[bytes, int], int] = {}
        lead = np.array([first.setdefault(d, i) for i, d in enumerate(zip(data, (hi - lo).tolist(), strict=True))], np.int64)
        copies = np.bincount(lead, minlength=len(data))
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        sent = np.flatnonzero(lead == np.arange(len(data)))
        sent = sent[np.argsort(bucket[sent], kind="stable")]
        out: list[tuple[int, bytes, bytes]] = []
        for a, b in zip(*(x.tolist() for x in runs(bucket[sent])), strict=True):
            own = sent[a:b]
            out.append((int(bucket[own[0]]), b"".join(data[i] for i in own.tolist()), meta[own].tobytes()))
        certain = np.flatnonzero(copies[lead] > 1)
        if len(certain):
            out.append((-1 - int(hashes[0] % np.uint64(buckets)), b"", meta[certain].tobytes()))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["bucket", "data", "meta"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, np.ndarray]] = []
        size, done = 0, set()
        for id_, key, text, found in meeting.documents(batches):
            if not found or (id_, key) in done:  # a repeated row is the same document
                continue
            done.add((id_, key))
            wanted = np.concatenate(found).astype(np.int64)
            if len(text) > 2 * chunk:
                for begin, end, _ in _cut_bytes(np.frombuffer(text, np.uint8), chunk, LENGTH):
                    yield from cut([(id_, key, text[begin:end], wanted - begin)], begin, chunk)
                continue
            held.append((id_, key, text, wanted))
            size += len(text)
            if size >= chunk:
                yield from cut(held)
                held, size = [], 0
        if held:
            yield from cut(held)

    return meeting.sides(texts, candidates, groups).mapInArrow(kernel, _PIECES)


@dataclass
class _Shard:
    data: np.ndarray
    starts: np.ndarray  # of all strings, by piece
    room: np.ndarray  # bytes from each start to its piece's end
    order: np.ndarray  # all starts in suffix order
    common: np.ndarray  # prefix that each shares with the one before, up to the longest length
    hit: dict[int, np.ndarray]  # by length: whether the string at a place is repeated

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings of ``length`` bytes in suffix order, and a number that equal ones share."""
        if not len(self.order):
            return self.order, self.order
        fits = np.zeros(len(self.data), bool)
        fits[self.starts[self.room >= length]] = True
        at = np.flatnonzero(fits[self.order])
        if not len(at):
            return at, at
        same = _stretch_minima(self.common, at) >= length if len(at) > 1 else np.zeros(0, bool)
        return self.order[at], np.concatenate(([0], np.cumsum(~same)))


def _shard(pieces: list[bytes], strings: list[int], lengths: Sequence[int]) -> _Shard:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(sizes) - sizes
    starts = spread(first, strings)
    room = np.repeat(first + sizes, strings) - starts
    sa, _ = suffix.of_bytes(data)  # in full: Kasai needs the true order
    common = suffix.kasai(data, sa, max(lengths))
    owned = np.zeros(len(data), bool)
    owned[starts] = True
    at = np.flatnonzero(owned[sa])
    between = np.append(0, _stretch_minima(common, at)) if len(at) > 1 else np.zeros(len(at), np.int64)
    out = _Shard(data, starts, room, sa[at], between, {})
    for length in lengths:
        order, number = out.classes(length)
        hit = np.zeros(len(data), bool)
        a, b = runs(number)
        hit[order[np.repeat(b - a > 1, b - a)]] = True
        out.hit[length] = hit
    return out


def _stretch_minima(common: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum of common[at[i] + 1 .. at[i + 1]] for each i."""
    return np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1)


def repeated_strings(pieces: list[bytes], strings: list[int], lengths: Sequence[int] = (REPORT, LENGTH), shard: int = SHARD) -> list[list[np.ndarray]]:
    """For each piece and length, whether the string at each of its first ``strings`` places starts at another one too.

    Places that leave less than the length are never marked. Pieces are sorted in shards of about ``shard`` bytes.
    """
    if not pieces:
        return []
    groups: list[list[int]] = [[]]
    size = 0
    for i, p in enumerate(pieces):
        if size and size + len(p) > shard:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(p)
    shards = [_shard([pieces[i] for i in g], [strings[i] for i in g], lengths) for g in groups]
    if len(shards) > 1:
        for length in lengths:
            _merge(shards, length)
    marks: list[list[np.ndarray]] = [[] for _ in pieces]
    for group, own in zip(groups, shards, strict=True):
        for length in lengths:
            flat, at = own.hit[length][own.starts], 0
            for i in group:
                marks[i].append(flat[at : at + strings[i]])
                at += strings[i]
    return marks


def _merge(shards: list[_Shard], length: int) -> None:
    """Mark strings that begin in two shards: classes' keys are sorted, searched in each other, and verified."""
    tables = []
    for own in shards:
        order, number = own.classes(length)
        first, last = runs(number)
        lead = order[first]
        key = mixed(rolling(own.data.astype(np.uint64) + np.uint64(1), lead, lead + length, _BASE))
        by = np.argsort(key)
        tables.append((key[by], lead[by], first[by], (last - first)[by], suffix.byte_keys(own.data), order))
    # words at these offsets cover a string: every eight bytes, and the last eight
    offsets = [*range(0, length - 7, 8), length - 8]
    for i, (keys, leads, _, _, words, _) in enumerate(tables):
        for j in range(i):
            other, other_leads, _, _, other_words, _ = tables[j]
            if not len(keys) or not len(other):
                continue
            at = np.minimum(np.searchsorted(other, keys), len(other) - 1)
            x = np.flatnonzero(other[at] == keys)
            y = at[x]
            for d in offsets:
                same = words[leads[x] + d] == other_words[other_leads[y] + d]
                x, y = x[same], y[same]
            for k, rows in ((i, x), (j, y)):
                _, _, first, count, _, order = tables[k]
                shards[k].hit[length][order[spread(first[rows], count[rows])]] = True


def _marked(sent: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Findings: byte intervals as pairs of 32-bit numbers, (start, end) to remove and (end, start) only to report."""

    def intervals(report: np.ndarray, remove: np.ndarray) -> np.ndarray:
        """Pairs from the marks of a piece's strings; nothing is only reported that is removed as a whole."""
        s, e = runs(remove)
        gone = np.stack((s, e - 1 + LENGTH), 1)[remove[s]]
        s, e = runs(report)
        told = np.stack((e - 1 + REPORT, s), 1)[report[s]]
        if len(gone) and len(told):
            over = np.maximum(np.searchsorted(gone[:, 0], told[:, 1], side="right") - 1, 0)
            told = told[(gone[over, 0] > told[:, 1]) | (gone[over, 1] < told[:, 0])]
        return np.concatenate((gone, told)).ravel()

    def out(meta: np.ndarray, spans: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in spans], np.int64)
        flat = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        return meeting.packed(np.repeat(meta[:, 0], sizes), np.repeat(meta[:, 1], sizes), flat, groups)

    def bucket_of(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        meta = np.concatenate([np.frombuffer(m, np.int64).reshape(-1, _META) for _, m in held])
        owners: dict[tuple[bytes, int], list[int]] = {}
        i = 0
        for data, m in held:
            at = 0
            for n, strings in np.frombuffer(m, np.int64).reshape(-1, _META)[:, [3, 5]].tolist():
                owners.setdefault((data[at : at + n], strings), []).append(i)
                at += n
                i += 1
        # only pieces of one anchor can hold equal strings: one that is its anchor's sole distinct piece is not sorted
        _, anchor, count = np.unique(meta[[own[0] for own in owners.values()], 4], return_inverse=True, return_counts=True)
        several = (count[anchor] > 1).tolist()
        sorted_ = [key for key, s in zip(owners, several, strict=True) if s]
        marks = iter(repeated_strings([p for p, _ in sorted_], [n for _, n in sorted_]))
        rows, spans = [], []
        for ((piece, strings), own), partner in zip(owners.items(), several, strict=True):
            found = next(marks) if partner else None
            if len(own) > 1:
                pairs = np.array(_covered(0, strings, len(piece)), np.int64)
            elif found is not None and found[0].any():
                pairs = intervals(*found)
            else:
                continue
            for i in own:
                rows.append(i)
                spans.append(pairs + meta[i, 2])
        return out(meta[rows], spans)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, data, meta = (c[i].as_py() for c in batch.columns)
                if bucket != now and held:
                    yield bucket_of(held)
                    held = []
                now = bucket
                if bucket < 0:
                    rows = np.frombuffer(meta, np.int64).reshape(-1, _META)
                    yield out(rows, [np.array(_covered(a, strings, n)) for a, n, _, strings in rows[:, 2:].tolist()])
                else:
                    held.append((data, meta))
        if held:
            yield bucket_of(held)

    return dealt(sent, "bucket", buckets).sortWithinPartitions("bucket").mapInArrow(kernel, meeting.FOUND)


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated``.

    A byte goes if it lies in a string of 400 bytes that starts anywhere else, in any document, this one
    included. ``n_repeated`` counts the bytes in strings of 240 bytes that do: nothing is removed for those alone. Null texts are empty; shorter texts lose nothing. Rows that repeat id and text are one
    document, not repetitions of each other, and get the same result each; equal texts of other ids are
    repetitions. Null ids are one id. Extra columns are ignored. Empty in, empty out.
    """
    ready(docs)
    texts = meeting.keyed(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = meeting.groups_for(total)
    buckets, pieces = max(1, math.ceil(total / ANCHORS)), max(1, math.ceil(total / PIECES))
    candidates = counted(hashed(texts, _anchor_hashes, _cut_bytes, buckets, True, chunk), buckets, True, groups)
    found = _marked(_pieces(texts, candidates, groups, pieces, chunk), pieces, groups)

    def finish(text: bytes, findings: list[np.ndarray]) -> tuple[int, int, int, str, int]:
        pairs = np.concatenate(findings).astype(np.int64).reshape(-1, 2) if findings else np.zeros((0, 2), np.int64)
        gone = pairs[pairs[:, 0] < pairs[:, 1]]
        told, until = merged(pairs.min(1), pairs.max(1))
        s, e = merged(gone[:, 0], gone[:, 1])
        kept, at = hashlib.sha256(), 0
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        return len(text), int((e - s).sum()), len(s), kept.hexdigest(), int((until - told).sum())

    return meeting.meet(texts, found, groups, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long", id_col)
