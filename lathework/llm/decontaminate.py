"""Benchmark decontamination with suffix arrays over the training words.

Each task turns its documents into shards: word numbers from the benchmark's vocabulary, of which only
stretches of known words that are long enough to hold a window remain (a word outside the vocabulary
ends every match, so nothing is lost). The shard's suffix array is built and every benchmark suffix is
searched in it by its first window; the stretch found gives all verbatim occurrences. Occurrences that
follow each other in the document and in the item join up to the longest verbatim matches of the suffix,
which are returned with their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import suffix
from .common import CHUNK_BYTES, docs_of, fresh, gathered, materialize, merged, ready, runs, spread, text_bytes

#: Words of benchmark text held at once; larger benchmarks are searched block by block.
BLOCK_WORDS = 400_000

_KEEP = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: digits, ASCII letters and everything beyond ASCII."""
    return text.translate(_KEEP).split()


@dataclass
class Block:
    """Benchmark windows: word numbers, padded rows, and the items and places of each distinct window.

    Places count the words of all items of the block, with one word between items.
    """

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    item_starts: np.ndarray
    items: np.ndarray
    names: list[str]
    sequences: list[np.ndarray]
    place_starts: np.ndarray
    places: np.ndarray
    place_names: list[str]
    item_places: np.ndarray


def _block(rows: list[tuple[str, list[bytes]]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    names = sorted({name for name, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    of: dict[tuple[int, ...], set[int]] = {}
    places: dict[tuple[int, ...], list[int]] = {}
    sequences, firsts, at = [], [], 0
    for name, words in rows:
        firsts.append(at)
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        sequences.append(np.array(ids, np.int32))
        for i in range(max(1, len(ids) - window + 1)):
            of.setdefault(tuple(ids[i : i + window]), set()).add(number[name])
            places.setdefault(tuple(ids[i : i + window]), []).append(at + i)
        at += len(ids) + 1
    table = np.zeros((len(of), window), np.int32)
    lengths = np.zeros(len(of), np.int64)
    for i, w in enumerate(of):
        table[i, : len(w)] = w
        lengths[i] = len(w)
    counts = np.array([len(x) for x in of.values()], np.int64)
    return Block(
        vocabulary, table, lengths, np.append(0, np.cumsum(counts)), np.array([i for x in of.values() for i in sorted(x)], np.int64), names, sequences,
        np.append(0, np.cumsum([len(x) for x in places.values()])).astype(np.int64), np.array([i for x in places.values() for i in x], np.int64), [name for name, _ in rows], np.array(firsts, np.int64),
    )


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about ``most`` words; items without words are left out."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for name, text in benchmark.select(id_col, text_col).toLocalIterator():
        words = words_of((text or "").encode())
        if not words or name is None:
            continue
        if held and size + len(words) > most:
            yield _block(held, window)
            held, size = [], 0
        held.append((str(name), words))
        size += len(words)
    if held:
        yield _block(held, window)


@dataclass
class Found:
    """Per document of a chunk: words, hit stretches (flat starts and ends), item names, and maximal matches.

    A match is ``words:offset in the document:item``; they stand by offset, the longer first.
    """

    words: np.ndarray
    spans: list[np.ndarray]
    items: list[list[str]]
    matches: list[list[str]]


def scan(texts: Iterator[bytes], n_docs: int, block: Block) -> Found:
    get = block.vocabulary.get
    numbers, size = [], np.zeros(n_docs, np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        size[i] = len(words)
        numbers.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        numbers.append(np.zeros(1, np.int32))
    tokens = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    found = Found(size, [np.zeros(0, np.int64)] * n_docs, [[] for _ in range(n_docs)], [[] for _ in range(n_docs)])
    first = np.cumsum(size + 1) - (size + 1)
    starts, ends = runs(tokens > 0)
    long = (tokens[starts] > 0) & (ends - starts >= (block.lengths.min() if len(block.lengths) else 1))
    starts, length = starts[long], (ends - starts)[long] + 1  # the word that ends a stretch is a 0
    kept = spread(starts, length)
    if not len(kept) or not len(block.lengths):
        return found
    shard = tokens[kept]
    sa, _ = suffix.of_tokens(shard, block.windows.shape[1])
    lo, hi = suffix.bounds(shard, sa, block.windows, block.lengths)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return found
    at = kept[sa[spread(lo[hit], (hi - lo)[hit])]]
    which = np.repeat(hit, (hi - lo)[hit])
    cover = np.zeros(len(tokens) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + block.lengths[which], -1)
    s, e = runs(np.cumsum(cover) > 0)
    on = np.cumsum(cover)[s] > 0
    s, e = s[on], e[on]
    doc = np.searchsorted(first, s, side="right") - 1
    ds, de = runs(doc)
    for a, b in zip(ds.tolist(), de.tolist(), strict=True):
        d = int(doc[a])
        found.spans[d] = np.stack((s[a:b] - first[d], e[a:b] - first[d]), 1).ravel()
    n_items = (block.item_starts[1:] - block.item_starts[:-1])[which]
    item = block.items[spread(block.item_starts[which], n_items)]
    pair = np.unique(np.repeat(np.searchsorted(first, at, side="right") - 1, n_items) * len(block.names) + item)
    for p in pair.tolist():
        found.items[p // len(block.names)].append(block.names[p % len(block.names)])
    _join_up(found, block, at, which, first)
    return found


def _join_up(found: Found, block: Block, at: np.ndarray, which: np.ndarray, first: np.ndarray) -> None:
    """Longest matches: occurrences whose document and benchmark places advance together are one match."""
    n = (block.place_starts[1:] - block.place_starts[:-1])[which]
    place = block.places[spread(block.place_starts[which], n)]
    at, size = np.repeat(at, n), np.repeat(block.lengths[which], n)
    order = np.lexsort((at, place - at))
    at, place, size = at[order], place[order], size[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(place - at) != 0) | (np.diff(at) != 1))))
    last = np.append(new[1:], len(at)) - 1
    words = at[last] - at[new] + size[last]
    doc = np.searchsorted(first, at[new], side="right") - 1
    item = np.searchsorted(block.item_places, place[new], side="right") - 1
    for d, w, a, i in zip(doc.tolist(), words.tolist(), (at[new] - first[doc]).tolist(), item.tolist(), strict=True):
        found.matches[d].append(f"{w}:{a}:{block.place_names[i]}")
    for d in np.unique(doc).tolist():
        found.matches[d] = _ordered(found.matches[d])


def _ordered(matches: list[str]) -> list[str]:
    """Distinct matches by offset, longer ones first, then by item."""

    def key(match: str) -> tuple[int, int, str]:
        words, offset, item = match.split(":", 2)
        return int(offset), -int(words), item

    return sorted(set(matches), key=key)


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.concatenate((np.asarray(a, np.int64).reshape(-1, 2), np.asarray(b, np.int64).reshape(-1, 2)))
    return np.stack(merged(both[:, 0], both[:, 1]), 1).ravel()


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches string"


def _annotated(docs: DataFrame, blocks_: Iterator[Block], text_col: str, finish: Callable[[pa.RecordBatch, Found], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Run the blocks over the documents, a pass each; ``finish(batch, Found)`` makes the rows of the last.

    The driver holds a block and the next one. Between passes the documents are written to the shared folder
    with what was found, so that no task gets more than one block.
    """
    name = fresh(docs, "spans", "items", "matches")
    kept = [name("spans"), name("items"), name("matches")]
    kinds = [T.ArrayType(T.LongType()), T.ArrayType(T.StringType()), T.ArrayType(T.StringType())]
    fields = T.StructType([*docs.schema.fields, *[T.StructField(k, t) for k, t in zip(kept, kinds, strict=True)]])
    block, before = next(blocks_, None) or _block([], 10), None
    while True:
        after = next(blocks_, None)

        def kernel(batches: Iterator[pa.RecordBatch], block: Block = block, first: bool = before is None, last: bool = after is None) -> Iterator[pa.RecordBatch]:
            for part in gathered(batches, text_col, CHUNK_BYTES):
                found = scan(docs_of(*text_bytes(part.column(text_col))), part.num_rows, block)
                if not first:
                    spans, items, matches = (part.column(c).to_pylist() for c in kept)
                    found.matches = [_ordered([*a, *b]) for a, b in zip(matches, found.matches, strict=True)]
                    found.spans = [_union(a, b) for a, b in zip(spans, found.spans, strict=True)]
                    found.items = [sorted({*a, *b}) for a, b in zip(items, found.items, strict=True)]
                    part = part.drop_columns(kept)
                if last:
                    yield finish(part, found)
                else:
                    spans = pa.array([x.tolist() for x in found.spans], pa.list_(pa.int64()))
                    lists = [pa.array(x, pa.list_(pa.string())) for x in (found.items, found.matches)]
                    yield pa.RecordBatch.from_arrays([*part.columns, spans, *lists], names=[*part.schema.names, *kept])

        if after is None:
            return docs.mapInArrow(kernel, schema)
        docs = before = materialize(docs.mapInArrow(kernel, fields), "decontamination", replaces=before)
        block = after


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: ``id, n_words, n_hit, n_items, items_sha256, contaminated, matches``.

    A window is ``window`` consecutive words of an item; shorter items are one window. ``n_hit`` counts
    the document's words inside any occurrence of a window. ``matches`` lists every maximal verbatim match as
    words:offset:item, comma-joined, by offset. Null or wordless texts have no words and no hits; very long
    texts are read whole; items that are null or wordless or have a null id never match; repeated items and ids
    count once in ``n_items``; repeated documents keep a row each. Extra columns are ignored, whatever their
    names. An empty benchmark leaves every document clean; no documents give no rows.
    """
    ready(docs)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def finish(part: pa.RecordBatch, found: Found) -> pa.RecordBatch:
        hit = np.array([int((x[1::2] - x[::2]).sum()) for x in found.spans], np.int64)
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found.items]
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(found.words), pa.array(hit), pa.array([len(x) for x in found.items], pa.int64()), pa.array(digest, pa.string()), pa.array(hit > 0), pa.array([",".join(x) for x in found.matches], pa.string())],
            names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"],
        )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {RESULT}"
    return _annotated(own, blocks(benchmark, item_col, item_text_col, window, block_words), "text", finish, schema).withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no benchmark window occurs, all columns, of any name, and repeated rows kept.

    Null and empty texts, null ids and very long texts are treated as by ``decontaminate``.
    """
    ready(docs)

    def finish(part: pa.RecordBatch, found: Found) -> pa.RecordBatch:
        return part.filter(pa.array([not len(x) for x in found.spans], pa.bool_()))

    return _annotated(docs, blocks(benchmark, item_col, item_text_col, window, block_words), text_col, finish, docs.schema)
