"""Near-duplicate detection: 64-bit SimHash with Golay-code fuzzy keys.

The fingerprint is cut into four 16-bit segments. If two fingerprints differ in at most three bits,
then for some c segment c is equal and segment c+1 (cyclically) differs in at most one bit: three
errors leave a zero-error segment whose successor does not hold two of them. Segment c+1, padded to
23 bits, is decoded by the perfect [23,12,7] Golay code, and so is each of its one-bit neighbours;
the codeword indices reached are its keys (six at most). Segments one bit apart share a key. So
joining on (c, segment c, one index of segment c+1) finds every pair, and the full distance verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import chunks, components, docs_of, fresh, materialize, ready, runs, text_bytes
from .near_copies import shingle_hashes

#: Most bits in which linked fingerprints differ; the key scheme is built for this number.
MOST_BITS = 3
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@cache
def golay_errors() -> np.ndarray:
    """The error pattern of weight at most three for each of the 2048 syndromes."""
    bits = 1 << np.arange(23)
    patterns = [0, *bits]
    patterns += [bits[i] | bits[j] for i in range(23) for j in range(i)]
    patterns += [bits[i] | bits[j] | bits[k] for i in range(23) for j in range(i) for k in range(j)]
    table = np.zeros(2048, np.int64)
    table[_syndromes(np.array(patterns))] = patterns
    return table


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    words = np.asarray(words, np.int64)
    return (words ^ golay_errors()[_syndromes(words)]) >> 11


@cache
def segment_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment its distinct codeword indices, padded with -1, and their number."""
    own = np.arange(1 << 16)
    near = own[:, None] ^ np.concatenate(([0], 1 << np.arange(16)))[None, :]
    found = np.sort(golay_index(near), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found = -np.sort(-found, axis=1)
    count = (found >= 0).sum(1)
    return found[:, : count.max()], count


def bits(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingle hashes; without any it is zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text's shingles, repeats included; texts without words get zero."""
    return bits(np.array(shingle_hashes(text, shingle), np.uint64))


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, fp long)`` per row; ``fp`` holds the unsigned fingerprint's bits."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            found = np.fromiter((fingerprint(t, shingle) for t in docs_of(*text_bytes(part.column(text_col)))), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(kernel, schema)


def _spanning(members: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links members within MOST_BITS; ``members`` are distinct."""
    rest, found = members, []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for a in front:
                near = ~reached & (np.bitwise_count(rest ^ a) <= MOST_BITS)
                found += [(int(a), int(b)) for b in rest[near]]
                reached |= near
                if reached.all():
                    break
            front, rest = rest[reached], rest[~reached]
    return found


def _edges_of(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    keys = np.concatenate([k for k, _ in held])
    prints = np.concatenate([f for _, f in held]).view(np.uint64)
    found: list[tuple[int, int]] = []
    starts, ends = runs(keys)
    many = ends - starts > 1
    for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
        if b - a == 2:
            if int(prints[a] ^ prints[a + 1]).bit_count() <= MOST_BITS:
                found.append((int(prints[a]), int(prints[a + 1])))
        else:
            found += _spanning(prints[a:b])
    return found


def links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that connect all within MOST_BITS.

    Each key's bucket gives a spanning forest of its links, never all pairs. A bucket holds distinct
    fingerprints only, eight bytes each, however many documents share them.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count = segment_keys()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            wide = fp.view(np.uint64)
            segments = [(wide >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
            for c in range(4):
                near = segments[(c + 1) % 4]
                n = count[near]
                index = table[near][np.arange(table.shape[1])[None, :] < n[:, None]]
                key = np.repeat(c << 28 | segments[c] << 12, n) | index
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(fp, n))], names=["key", "fp"])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            last = int(np.searchsorted(key, key[-1]))
            held.append((key[:last], fp[:last]))
            if last:
                yield out(_edges_of(held))
                held = []
            held.append((key[last:], fp[last:]))
        if held:
            yield out(_edges_of(held))

    keyed = prints.select("fp").mapInArrow(keys, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(bucket, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``id, fingerprint (16 hex digits), component_id``.

    ``component_id`` is the smallest id reached over links of at most three bits, the document's own
    included. Null and empty texts and texts of blanks have fingerprint zero and are linked like any
    other. Texts below ``shingle`` words hash as one shingle. Repeated ids keep a row each; a null id is
    never a component_id unless the whole component has none. Very long texts are hashed whole. Extra
    columns, whatever their names, are ignored. Empty in, empty out.
    """
    ready(docs)
    own, wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_col
    id_col, text_col = "id", "text"
    base = materialize(with_fingerprints(own, id_col, text_col, shingle), "simhash")
    prints = base.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = components(links(prints), "simhash-links")
    labelled = prints.join(roots, prints.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = labelled.join(lows, "root").select("fp", "component_id")
    return base.join(of_print, "fp").select(F.col(id_col).alias(wanted), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with smallest id of each component of near copies, all columns kept.

    Linked are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least. Candidates
    are the links of the sets' SimHashes, found by their Golay keys as in ``near_duplicates``; as many
    similar texts differ in more than three bits, MinHash adds candidates (module ``near_copies``). The sets
    decide on all of them. Texts without words are copies of each other. Rows that repeat the kept id in a component are dropped but one; rows of
    one id in different components are several documents. Documents with a null id stay. Columns of any
    name are kept. Empty in, empty out.
    """
    ready(docs)
    row = fresh(docs, "row")("row")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = near_copies.label(own, "id", "text", bits, links).select(F.col("low.row").alias(row))
    with_id = docs.where(F.col(id_col).isNotNull()).withColumn(row, near_copies.row_hash(id_col, text_col)).join(kept, row, "left_semi").dropDuplicates([row])
    return with_id.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
