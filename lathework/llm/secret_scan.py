"""Secret scanning with Spark's own functions only.

Base kinds are plain patterns. The method adds ``entropy`` spans: candidate strings (long runs of token
characters) lose the parts that the allow list names; what is left, if it has letters and digits, is classed
by its characters, and a window slides over it. The fold's state carries the window's character counts k and
S = sum of k log2 k: one character leaves (its count falls by one), one enters (its count rises by one), and
the window's Shannon entropy is log2(width) - S / width. Windows at or above the class's threshold give the
span from the first such window's start to the last one's end, drawn out over letters and digits on either
side, unless base spans cover all of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Base patterns, in the order that breaks ties. These values are fixed by the contract.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Character classes, tried in this order: name, pattern of a whole candidate, least entropy in bits. Of random
#: strings of 24 to 64 characters 0.99 have such a window, of paths, slugs and identifiers made of words and numbers 0.04.
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", 3.0),
    ("alnum", r"^[0-9A-Za-z]+$", 3.85),
    ("base64", r"^[0-9A-Za-z+/=]+$", 3.85),
    ("token", r"^[0-9A-Za-z+/_=-]+$", 3.85),
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW, MOST_WINDOW = 20, 60
_CHUNK = 236  # candidates are looked at in pieces, so that substring() stays cheap on long ones
# A window's counts are a string: the character at a token character's place, its code less _LOW, is _ZERO + count.
_LOW, _HIGH, _ZERO = ord("+") - 1, ord("z"), 64

#: Parts of candidates that are no secrets: UUIDs, runs of one character, spelled-out alphabets, and words
#: between separators that name a placeholder.
ALLOWED = (
    r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])",
    r"(?<run>.)\k<run>{11,}",
    r"(?i:abcdefghijklm[a-z]*|0123456789(?:0123|abcdef)[0-9a-z]*)",
    r"(?i:[0-9a-z]*(?:example|placeholder|change_?me|your[_-]?(?:api|secret|token|key))[0-9a-z]*)",
)

_SPAN = "array<struct<start:long,kind:int,end:long>>"
KINDS = ("assign", "access", "hex", "entropy")


def _positions(text: Column, hits: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the kept hits: lengths of the pieces between hits give the positions."""
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(keep(pair["hit"]), F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.when(F.exists(hits, keep), F.aggregate(pairs, start, step)["found"]).otherwise(F.array().cast(_SPAN))


def _entropy_range(piece: Column, least: Column, window: int) -> Column:
    """``struct(first, last)``: zero-based start of the first and end of the last window at the threshold.

    Every place has two steps: the character that the window loses, then the one that it gains.
    """
    table = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(window + 2)])
    bits = math.log2(window)

    def step(acc: Column, event: Column) -> Column:
        place, enters = F.shiftright(event, 1), event.bitwiseAND(1) == 1
        change = F.when(enters, 1).otherwise(-1)
        slot = F.ascii(F.substring(piece, F.when(enters, place).otherwise(place - window), F.lit(1))) - _LOW
        count = F.ascii(F.substring(acc["counts"], slot, F.lit(1))) - _ZERO
        s = acc["s"] + F.get(table, count + change) - F.get(table, count)
        hit = enters & (place >= window) & (F.lit(bits) - s / window >= least)
        moved = F.struct(
            F.overlay(acc["counts"], F.char(count + change + _ZERO), slot, F.lit(1)).alias("counts"),
            s.alias("s"),
            F.when(hit & acc["first"].isNull(), place - window).otherwise(acc["first"]).alias("first"),
            F.when(hit, place).otherwise(acc["last"]).alias("last"),
        )
        return F.when(enters | (place > window), moved).otherwise(acc)

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(chr(_ZERO) * (_HIGH - _LOW)).alias("counts"), F.lit(0.0).alias("s"), none.alias("first"), none.alias("last"))
    return F.aggregate(F.sequence(F.lit(2), F.length(piece) * 2 + 1), start, step)


def _parts(hit: Column, allowed: Sequence[str], window: int) -> Column:
    """``array<struct(at, part)>``: what the allow list leaves of a candidate and still may be a secret."""
    if allowed:
        every = "|".join(f"(?:{p})" for p in allowed)
        gone, left = F.regexp_extract_all(hit, F.lit(every), F.lit(0)), F.split(hit, every, -1)
    else:
        gone, left = F.array().cast("array<string>"), F.array(hit)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,part:string>>").alias("parts"))

    def step(acc: Column, pair: Column) -> Column:
        own = F.struct(acc["at"].alias("at"), pair["left"].alias("part"))
        end = acc["at"] + F.length(pair["left"]) + F.coalesce(F.length(pair["gone"]), F.lit(0))
        return F.struct(end.alias("at"), F.concat(acc["parts"], F.array(own)).alias("parts"))

    found = F.aggregate(F.arrays_zip(left.alias("left"), gone.alias("gone")), start, step)["parts"]
    return F.filter(found, lambda p: (F.length(p["part"]) >= window) & p["part"].rlike("[0-9]") & p["part"].rlike("[A-Za-z]"))


def _scored(start: Column, text: Column, kind: int, window: int) -> Column:
    """The entropy span of a candidate, with nulls if no window reaches the threshold."""
    least = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(text.rlike(pattern), F.lit(bits)).otherwise(least)
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))

    def part(chunk: Column, i: Column) -> Column:
        piece = F.concat(chunk, F.coalesce(F.substring(F.get(parts, i + 1), 1, window - 1), F.lit("")))
        found = _entropy_range(piece, least, window)
        return F.struct((found["first"] + i * _CHUNK).alias("first"), (found["last"] + i * _CHUNK).alias("last"))

    ranges = F.transform(parts, part)
    first = F.array_min(F.transform(ranges, lambda r: r["first"]))
    last = F.array_max(F.transform(ranges, lambda r: r["last"]))
    before = F.length(F.regexp_extract(F.substring(text, F.lit(1), first), "[0-9A-Za-z]*$", 0))
    after = F.length(F.regexp_extract(F.substring(text, last + 1, F.lit(2147483647)), "^[0-9A-Za-z]*", 0))
    return F.struct((start + first - before).alias("start"), F.lit(kind).alias("kind"), (start + last + after).alias("end"))


def _covered(span: Column, base: Column) -> Column:
    """Whether base spans, which are sorted by start, leave nothing of the span."""
    return F.aggregate(base, span["start"], lambda reach, b: F.when(b["start"] <= reach, F.greatest(reach, b["end"])).otherwise(reach)) >= span["end"]


def with_spans(docs: DataFrame, text_col: str = "text", allowed: Sequence[str] = ALLOWED, window: int = WINDOW) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns, and their names: base spans and all spans, sorted arrays of struct(start, kind, end).

    Positions are code points, kinds numbers of KINDS. The names are none that ``docs`` has.
    """
    if not 2 <= window <= MOST_WINDOW:
        raise ValueError(f"the window must have 2 to {MOST_WINDOW} characters")
    hex_pattern = rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}+"  # maximal runs that are long enough: what is left of [0-9a-f]+
    patterns = {"assign": BASE[0][1], "access": BASE[1][1], "hex": hex_pattern, "candidate": CANDIDATE}
    name = fresh(docs, "text", "base", "spans", "fresh", *patterns, *[f"s{i}" for i in range(4)])
    text = F.col(name("text"))
    found = docs.withColumn(name("text"), F.coalesce(F.col(text_col), F.lit("")))
    found = found.withColumns({name(k): F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    keep = {
        "assign": lambda hit: F.length(F.regexp_extract(hit, BASE[0][1], 2)) >= ASSIGN_LEAST,
        "access": lambda hit: F.length(hit) >= ACCESS_LEAST,
        "hex": lambda hit: F.length(hit) >= HEX_LEAST,
        "candidate": lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"),
    }
    found = found.withColumns({name(f"s{i}"): _positions(text, F.col(name(k)), patterns[k], i, keep[k]) for i, k in enumerate(keep)})
    found = found.withColumn(name("base"), F.array_sort(F.concat(name("s0"), name("s1"), name("s2"))))
    parts = F.flatten(
        F.transform(
            name("s3"),
            lambda c: F.transform(
                _parts(F.substring(text, (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int")), allowed, window), lambda p: F.struct((c["start"] + p["at"]).alias("at"), p["part"].alias("part"))
            ),
        )
    )
    scored = F.filter(F.transform(parts, lambda p: _scored(p["at"], p["part"], 3, window)), lambda s: s["start"].isNotNull())
    found = found.withColumn(name("fresh"), F.when(F.size(name("s3")) > 0, F.filter(scored, lambda s: ~_covered(s, F.col(name("base"))))))
    every = F.when(F.col(name("fresh")).isNotNull(), F.array_sort(F.concat(name("base"), name("fresh")))).otherwise(F.col(name("base")))
    found = found.withColumn(name("spans"), every)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], name("base"), name("spans")), name("base"), name("spans")


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(n) for n in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Sequence[str] = ALLOWED, window: int = WINDOW) -> DataFrame:
    """One row per document: ``id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans``.

    Null and empty texts have no spans; very long ones are scanned whole. Repeated rows keep a row each, as do
    null ids; ties in start are broken by kind. Other columns, whatever their names, are ignored. Empty in, empty out.
    """
    found, base, spans = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("in")), "in", allowed, window)

    def n(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), n(3).alias("n_entropy"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", allowed: Sequence[str] = ALLOWED, window: int = WINDOW) -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; overlapping spans give one mark.

    A column ``n_chars``, if there is one, follows the new text. Texts without spans, nulls and empty ones
    included, stay as they are; repeated rows are treated alike. Columns of any name are kept. Empty in, empty out.
    """
    found, _, spans = with_spans(docs, text_col, allowed, window)
    text = F.col(f"`{text_col}`")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return (
            F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], between, F.lit(mark)).alias("out")))
            .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
        )

    new = fresh(docs, "new")("new")
    found = found.withColumn(new, F.when(F.size(spans) > 0, F.aggregate(spans, start, step)))
    changed = F.col(new).isNotNull()
    columns = {text_col: F.when(changed, F.concat(F.col(f"{new}.out"), F.substring(text, (F.col(f"{new}.at") + 1).cast("int"), F.lit(2147483647)))).otherwise(text)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(columns[text_col])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])
