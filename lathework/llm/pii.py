"""Personal data: fixed patterns, then bootstrapped contextual extraction.

The patterns' matches are seeds. Every seed and every other token of an identifier's shape is an instance;
the words around each occurrence are its lexical patterns: two words before it, one, two with a word between
that is skipped, one on either side, two after it. Words with digits stand for any number. The graph of
patterns and instances is scored on the cluster in rounds: a pattern's confidence is the share of its
instances that are seeds or accepted (smoothed), an instance's score the confidence of its best pattern with
enough seeds, and an instance is accepted at the least confidence; so no pattern lifts itself by instances
that are not accepted. Good patterns then mark the accepted unseen instances that stand in them as ``found``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, docs_of, materialize, ready, text_bytes

KINDS = ("email", "ip", "card", "phone", "found")
# Fixed by the contract. An e-mail match holds one @, so its domain is searched and the name taken leftwards.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")  # a match never begins inside digits: each run is tried once
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ROUNDS = 3
#: A pattern needs this confidence and this many distinct seeds; a found instance this score.
CONFIDENCE, SEEDS, SMOOTHING = 0.8, 3, 0.5
_CONTEXT = 64  # characters on either side from which context words are taken
_SHAPE = re.compile(r"[0-9](?:[^\s0-9]{0,8}[0-9]){5}|@")  # six digits of one token, near each other, or an @
_TOKEN = re.compile(r"[A-Za-z0-9@._+/#-]{6,}$")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=~"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and kind."""
    found = []
    last = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        name_at = at
        while name_at > last and (c := text[name_at - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            name_at -= 1
        if name_at < at:
            found.append((name_at, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 3 or (len(p) == 3 and p <= "255") for part in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def shaped_tokens(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens of an identifier's shape that no base span touches: six digits or an @, 6 characters at least."""
    out, last, base = [], 0, 0
    for m in _SHAPE.finditer(text):
        if m.start() < last:
            continue
        a, b = m.start(), m.end()
        while a > last and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        last = b
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        token = text[a:b]
        if not _TOKEN.match(token) or not ("@" in token[1:-1] or len(_DIGIT.findall(token)) >= 6):
            continue
        while base < len(taken) and taken[base][0] < a and max(e for _, _, e in taken[base : base + len(KINDS)]) <= a:
            base += 1  # spans of one kind don't overlap: those behind this token stay behind
        if not any(s < b and a < e for s, _, e in taken[max(0, base - len(KINDS)) :] if s < b):
            out.append((a, b))
    return out


def _words(text: str) -> list[str]:
    """Lower-cased words without punctuation; a word with digits is any number."""
    found = (w.strip(_EDGE).lower() for w in text.split())
    return ["0" if _DIGIT.search(w) else w for w in found]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence; empty words (punctuation alone) end a side."""
    before, after = _words(text[max(0, start - _CONTEXT) : start])[-3:], _words(text[end : end + _CONTEXT])[:2]
    out = []
    if before and before[-1]:
        w = before[-1]
        out.append(f"{w} _")
        if len(before) > 1 and before[-2]:
            out.append(f"{before[-2]} {w} _")
        if len(before) > 2 and before[-3]:
            out.append(f"{before[-3]} * {w} _")
        if after and after[0]:
            out.append(f"{w} _ {after[0]}")
    if len(after) > 1 and all(after):
        out.append(f"_ {after[0]} {after[1]}")
    return out


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_SEEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.int64()))]))
_SCHEMA = "key binary, base array<struct<start:long,kind:int,end:long>>, base_sha256 string, seen array<struct<start:long,end:long,instance:long,seed:boolean,patterns:array<long>>>"


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: base spans, their digest, and all occurrences of instances with their patterns."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            keys, bases, digests, seen = [], [], [], []
            for raw in docs_of(*text_bytes(part.column(text_col))):
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                rows = [(s, e, _hash(text[s:e].lower()), True, [_hash(c) for c in contexts(text, s, e)]) for s, _, e in base]
                rows += [(s, e, _hash(text[s:e].lower()), False, [_hash(c) for c in contexts(text, s, e)]) for s, e in shaped_tokens(text, base)]
                keys.append(hashlib.blake2b(raw, digest_size=12).digest())
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                seen.append([dict(zip(("start", "end", "instance", "seed", "patterns"), r, strict=True)) for r in rows if r[4]])
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(keys, pa.binary()), pa.array(bases, _SPANS), pa.array(digests, pa.string()), pa.array(seen, _SEEN)], names=[id_col, "key", "base", "base_sha256", "seen"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {_SCHEMA}")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """``(patterns(pattern, confidence, seeds), instances(instance, score))`` of ``edges(pattern, instance, seed)``.

    Edges are distinct; ``seed`` belongs to the instance. Each round is a join and a sum by pattern, then
    a join and a maximum by instance, written to the shared folder. Either join has one row a key on one
    side, so a frequent pattern or instance can be split.
    """
    instances = materialize(edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.max(F.col("seed").cast("double")).alias("score")), "pii-instances")
    patterns: DataFrame | None = None
    for _ in range(rounds):
        counted = F.when(F.col("score") >= confidence, F.col("score")).otherwise(0.0)
        weighed = edges.select("pattern", "instance").join(instances, "instance")
        patterns = materialize(
            weighed.groupBy("pattern").agg((F.sum(counted) / (F.count(F.lit(1)) + F.lit(SMOOTHING))).alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds")), "pii-patterns", replaces=patterns
        )
        voted = edges.select("pattern", "instance").join(patterns.where(F.col("seeds") >= seeds), "pattern")
        best = voted.groupBy("instance").agg(F.max("confidence").alias("best"))
        instances = materialize(
            instances.join(best, "instance", "left").select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score")), "pii-instances", replaces=instances
        )
    return patterns, instances


def _listed(spans: str | Column) -> Column:
    names = F.array(*[F.lit(n) for n in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """One row per document: ``id, n_email, n_ip, n_card, n_phone, n_found, base_sha256, spans``.

    Null texts count as empty and have no spans; very long ones are read whole, a batch of texts at a time. Empty in, empty out. Rows that repeat id and text get the same spans each; the same id with other
    texts is told apart by the text. Null ids keep their rows. Ties in start go by kind. Extra columns are ignored.
    """
    ready(docs)
    base = materialize(extract(docs, id_col, text_col), "pii-extracted")
    seen = base.select(F.col(id_col).alias("_id"), "key", F.explode("seen").alias("s")).select("_id", "key", "s.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = materialize(edges, "pii-edges")
    patterns, instances = score_patterns(edges, rounds, confidence, seeds)
    good = patterns.where((F.col("confidence") >= confidence) & (F.col("seeds") >= seeds)).select("pattern")
    likely = instances.where(~F.col("seed") & (F.col("score") >= confidence)).select("instance")
    unseen = seen.where(~F.col("seed")).select("_id", "key", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    unseen = unseen.join(good, "pattern", "left_semi").join(likely, "instance", "left_semi")
    span = F.struct("start", F.lit(KINDS.index("found")).alias("kind"), "end")
    found = materialize(unseen.groupBy("_id", "key").agg(F.collect_set(span).alias("found")), "pii-found")  # bounded by a document's own tokens
    left = base.withColumnRenamed("key", "_key")
    every = left.join(found, left[id_col].eqNullSafe(found["_id"]) & (left["_key"] == found["key"]), "left")
    every = every.withColumn("all", F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("found").cast("array<struct<start:long,kind:int,end:long>>")))))

    def n(kind: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    return every.select(F.col(id_col), n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"), n(4).alias("n_found"), "base_sha256", _listed("all").alias("spans"))
