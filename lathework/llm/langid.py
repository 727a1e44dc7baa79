"""Language identification by nearest centroid over TF-IDF n-gram vectors.

Texts are lower-cased, everything but letters becomes one blank, and byte trigrams (with bigrams at word
edges through the blanks) are hashed to ``DIMS`` counts. A vector is (1 + ln tf) * idf, normalised.
Each language has several centroids (spherical k-means); the nearest by cosine names the language. A
document whose cosine distance is beyond what training documents of a like number of n-grams show is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, ready, spread, text_bytes

#: Hashed n-gram dimensions.
DIMS = 1 << 13
#: Training documents, about, from which centroids and thresholds are fitted, over all languages. The
#: document frequencies come from all training documents.
SAMPLE = 2000
CENTROIDS = 4
ROUNDS = 8
#: A document is rejected if its similarity is below this share of the lowest one in hundred of training
#: documents with a like number of n-grams.
REJECT_SHARE = 0.5
#: What short texts are compared with: stretches of the sampled texts of so many n-grams.
STRETCHES = (8, 16, 32, 64)
UNKNOWN = "und"
_ROWS = 256  # dense vectors held at once

# Bytes of ASCII letters map to lower case, bytes beyond ASCII stay, all else is a blank.
_LOW = np.array([c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)], np.uint8)


def counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Dense trigram counts (rows x DIMS, int32) of the texts in a byte view."""
    n = len(off) - 1
    out = np.zeros((n, DIMS), np.int32)
    if not len(raw):
        return out
    low = _LOW[raw]
    # upper-case letters of two bytes in the Latin-1 block: C3 80..9E stands for C3 A0..BE
    upper = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3)) + 1
    low[upper] |= 0x20
    blank = low == 0x20
    keep = ~(blank & np.concatenate(([True], blank[:-1])))
    keep[off[:-1][off[:-1] < len(raw)]] = True  # a text's first byte never joins its neighbour's blanks
    low, place = low[keep], np.flatnonzero(keep)
    owner = np.searchsorted(off, place, side="right") - 1
    if len(low) < 3:
        return out
    a, b, c = (low[i : len(low) - 2 + i].astype(np.uint32) for i in range(3))
    whole = owner[:-2] == owner[2:]
    code = (a << 16 | b << 8 | c) * np.uint32(2654435761)
    bucket = (code >> np.uint32(32 - DIMS.bit_length() + 1)).astype(np.int64)
    flat = np.bincount((owner[:-2] * DIMS + bucket)[whole], minlength=n * DIMS)
    return flat.reshape(n, DIMS).astype(np.int32)


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors of count rows; rows without n-grams stay zero."""
    tf = np.zeros(found.shape, np.float32)
    np.log(found, out=tf, where=found > 0, casting="unsafe", dtype=np.float32)
    tf += found > 0
    tf *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", tf, tf))
    return tf / np.where(norm > 0, norm, 1)[:, None]


def held_out(id_col: str) -> Column:
    """Every fifth document by CRC-32 of its id as text; never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # (languages * centroids) x DIMS
    of: np.ndarray  # language number of each centroid
    idf: np.ndarray
    floor: np.ndarray  # least accepted similarity by log2 of the number of n-grams


def _document_frequencies(train: DataFrame, text_col: str) -> np.ndarray:
    """How many training documents hold each n-gram, and their number; one small row per task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for part in _parts(batches, text_col):
            found = counts(*text_bytes(part.column(text_col)))
            total[:DIMS] += (found > 0).sum(0)
            total[DIMS] += len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], names=["dim", "n"])

    rows = train.select(text_col).mapInArrow(kernel, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()  # DIMS + 1 rows
    out = np.zeros(DIMS + 1, np.int64)
    out[rows["dim"].to_numpy()] = rows["n"].to_numpy()
    return out


def _parts(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, text_col):
        for at in range(0, part.num_rows, _ROWS):
            yield part.slice(at, _ROWS)


def _spherical(x: np.ndarray, k: int) -> np.ndarray:
    """k-means by cosine, seeded by the farthest rows; deterministic."""
    centre = x.mean(0)
    chosen = [int(np.argmax(x @ centre))]
    best = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    centroids = x[chosen].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        for i in range(len(centroids)):
            if (own == i).any():
                centroids[i] = x[own == i].sum(0)
        norm = np.linalg.norm(centroids, axis=1, keepdims=True)
        centroids /= np.where(norm > 0, norm, 1)
    return centroids


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from documents that are not held out and have a language and a letter; None if there are none.

    Document frequencies cover all of them. Centroids are fitted on about ``sample`` documents, an equal share
    for each language (eight at least), drawn by a hash of id and text. Rows that repeat both, null ids
    included, are drawn as one, so neither they nor a language's name decide what is learned. Null and
    empty texts teach nothing, of very long ones all n-grams count. The thresholds for texts of fewer
    n-grams than the sample has come from stretches of its texts.
    """
    ready(docs)
    train = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col) & has_letter(text_col)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    frequency = _document_frequencies(train, "_text")
    if not frequency[DIMS]:
        return None
    idf = (np.log((1 + frequency[DIMS]) / (1 + frequency[:DIMS])) + 1).astype(np.float32)

    train = train.withColumn("_draw", F.xxhash64("_id", "_text"))
    sizes = {r["_lang"]: r["count"] for r in train.select("_lang", "_draw").distinct().groupBy("_lang").count().toLocalIterator()}  # a row per language
    share = max(8, sample // len(sizes))
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * share / n))]), F.col("_lang"))
    near = train.where(F.shiftrightunsigned("_draw", 11) * F.lit(2.0**-53) < rate).groupBy("_lang", "_draw").agg(F.min("_text").alias("_text"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.shiftrightunsigned("_draw", 11), "_draw"))  # over some two shares a language
    drawn = near.withColumn("_place", place).where(F.col("_place") <= share)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "_text"):
            raw, off = text_bytes(part.column("_text"))
            for width in (0, *STRETCHES):  # 0: the whole texts
                a, n = off[:-1], np.diff(off)
                if width:
                    a, n = a + np.maximum(n - width - 2, 0) // 2, np.minimum(n, width + 2)
                found = counts(raw[spread(a, n)], np.append(0, np.cumsum(n)))
                dims, values = [], []
                for row in found:
                    at = np.flatnonzero(row)
                    dims.append(at.astype("<u2").tobytes())
                    values.append(np.minimum(row[at], 65535).astype("<u2").tobytes())
                columns = [part.column("_lang"), pa.array(np.full(len(n), width)), pa.array(dims, pa.binary()), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_lang", "width", "dims", "n"])

    chosen = drawn.select("_lang", "_text").mapInArrow(kernel, "_lang string, width long, dims binary, n binary")
    rows = sorted((r[1], r[0], bytes(r[2]), bytes(r[3])) for r in chosen.toLocalIterator())  # a share a language at most, and its stretches
    names = sorted({r[1] for r in rows})

    def dense(some: list[tuple[int, str, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, numbers of n-grams) of a part of the rows."""
        found = np.zeros((len(some), DIMS), np.int32)
        for i, (_, _, dims, n) in enumerate(some):
            found[i, np.frombuffer(dims, "<u2")] = np.frombuffer(n, "<u2")
        return vectors(found, idf), np.maximum(found.sum(1), 1)

    whole = [r for r in rows if r[0] == 0]
    y = np.array([names.index(r[1]) for r in whole])
    x = np.concatenate([dense(whole[at : at + _ROWS])[0] for at in range(0, len(whole), _ROWS)])
    parts = [_spherical(x[y == i], CENTROIDS) for i in range(len(names))]
    of = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    centroids = np.concatenate(parts)
    near_by = []
    for at in range(0, len(rows), _ROWS):  # texts and stretches alike, a few at a time
        v, n = dense(rows[at : at + _ROWS])
        near_by.append(((v @ centroids.T).max(1), n))
    best, size = (np.concatenate(part) for part in zip(*near_by, strict=True))
    band = np.log2(size).astype(int)
    floor = np.full(32, np.inf)
    for b in range(32):
        near = best[np.abs(band - b) <= 1]
        if len(near) >= 20:
            floor[b] = REJECT_SHARE * np.quantile(near, 0.01)
    known = np.flatnonzero(np.isfinite(floor))
    if len(known):
        floor[known[-1] + 1 :] = floor[known[-1]]
        floor[: known[0]] = 0.0  # no training text is as short: nothing to compare with
    else:
        floor[:] = 0.0
    floor = np.minimum.accumulate(floor[::-1])[::-1]  # never stricter on shorter texts than on longer ones
    return Model(names, centroids.astype(np.float32), of, idf, floor)


def classify(part: pa.RecordBatch, text_col: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language numbers, cosines to the nearest centroid, and whether the distance rejects the text."""
    found = counts(*text_bytes(part.column(text_col)))
    near = vectors(found, model.idf) @ model.centroids.T
    best = near.argmax(1)
    score = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
    band = np.log2(np.maximum(found.sum(1), 1)).astype(int)
    return model.of[best], score, score < model.floor[band]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, held_out, lang_pred, score, rejected``.

    ``lang_pred`` is ``und``, the score 0 and the document rejected if the text is null or has no letter,
    or if nothing was learned. ``rejected`` marks texts too far from every centroid; their ``lang_pred``
    is still the nearest. Very short texts are compared with equally short stretches of training texts; very
    long ones are read whole. Rows with null or repeated ids keep a row each, ties go to the first language by
    name. Other columns, whatever their names, are ignored. Empty in, empty out.
    """
    ready(docs)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held_out(id_col).alias("_held"), has_letter(text_col).alias("_letter"))
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "_text"):
            letter = np.array(part.column("_letter").to_pylist(), bool)
            if model is None:
                language, score, far = np.zeros(len(letter), int), np.zeros(len(letter)), np.ones(len(letter), bool)
                letter = np.zeros(len(letter), bool)
                names = [UNKNOWN]
            else:
                language, score, far = classify(part, "_text", model)
                names = model.languages
            said = [names[i] if ok else UNKNOWN for i, ok in zip(language.tolist(), letter.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_held"), pa.array(said, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(far | ~letter)], names=[id_col, "held_out", "lang_pred", "score", "rejected"]
            )

    return own.mapInArrow(kernel, f"{id_col} {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_accepted(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the classifier accepts, with ``lang`` set to the language found.

    Null texts, texts without a letter and, where nothing was learned, all documents go. Repeated rows and
    null ids are treated alike; columns of any name are kept. Empty in, empty out.
    """
    ready(docs)
    mark = fresh(docs, "letter")("letter")
    marked = docs.withColumn(mark, has_letter(text_col))
    own = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, text_col):
            letter = np.array(part.column(mark).to_pylist(), bool)
            if model is None or not letter.any():
                continue
            language, _, far = classify(part, text_col, model)
            columns = {n: part.column(n) for n in own}
            if lang_col in columns:
                columns[lang_col] = pa.array([model.languages[i] for i in language.tolist()], pa.string())
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(letter & ~far))

    fields = [T.StructField(f.name, T.StringType()) if f.name == lang_col else f for f in docs.schema.fields]
    return marked.mapInArrow(kernel, T.StructType(fields))
