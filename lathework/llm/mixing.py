"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts are summed over the cells (source, language, topic). Each cell's expected tokens are raked
until their sums agree with the goal of every source, every language and every topic, and no cell gives
more than it has: in turn, the cells of each value are scaled towards the one factor that meets the value's goal
with the cells capped. Expected over available tokens is a cell's sampling probability.

A topic is the class of a text's form, unless the caller names a column that holds topics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, materialize, ready, remove, text_bytes

DIMENSIONS = ("source", "lang", "topic")
#: Share of all tokens that the sample is to have.
BUDGET = 0.5
#: Without given targets a value's target is its token share to this power, normalised.
FLATTEN = 0.5
ROUNDS, TOLERANCE, SEED = 400, 1e-6, 17
#: Share of the tokens by which a sum may miss its goal for the goals to count as met.
NEAR = 1e-3
#: Goals are given up as conflicting after so many rounds that bring their largest miss down by less than a tenth.
STALL = 20
#: Rates are held in this range; beyond it they change nothing but could overflow.
RANGE = (1e-30, 1e9)
#: Sums and rates this near their goal and cap have reached them, so that no last digit decides on a step.
SLACK = 1e-10
#: Cells that one task rakes in memory, some 200 bytes each; more are raked in the same way by Spark's aggregates.
MOST_CELLS = 200_000
#: Steps of the search for the least change of targets that no weights can meet.
STEPS = 10
MISSING = "(none)"
FORMS = ("empty", "table", "shouting", "data", "listing", "prose")


def forms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of blank-separated tokens, number of the form in FORMS) of the texts in a byte view."""
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    begins = ~blank
    begins[1:] &= blank[:-1]
    first = off[:-1][off[:-1] < len(raw)]
    begins[first] = ~blank[first]

    def count(hit: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(hit, dtype=np.int64))
        return total[off[1:]] - total[off[:-1]]

    n = count((raw & 0xC0) != 0x80)  # characters
    digits, upper = count((raw >= 0x30) & (raw <= 0x39)), count((raw >= 0x41) & (raw <= 0x5A))
    bars, breaks = count(raw == 0x7C), count(raw == 0x0A)
    form = np.select([n == 0, bars * 50 > n, upper * 3 > n, digits * 10 > n, breaks * 60 > n], range(5), 5)
    return count(begins), form


def features(text: Column, batch_bytes: int = 8 << 20) -> Column:
    """``struct(tokens, topic)`` of a text; null counts as empty. Texts alone travel to Python, in Arrow batches."""

    @F.arrow_udf("struct<tokens:long,topic:string>")
    def of(texts: pa.Array) -> pa.Array:
        tokens, form = [], []
        for part in chunks([pa.RecordBatch.from_arrays([texts], names=["t"])], "t", batch_bytes):
            n, k = forms(*text_bytes(part.column(0)))
            tokens.append(n)
            form.append(k)
        tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        names = pa.array(FORMS).take(pa.array(np.concatenate(form) if form else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), names], names=["tokens", "topic"])

    return of(text)


# -- raking: what both ways of running it share


def _settled[S](begin: Callable[[float], S], turn: Callable[[S], tuple[S, float]], drop: Callable[[S], None], whole: float, steps: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> S:
    """The raked state for the least step, by bisection, at which all goals are met.

    ``begin(step)`` gives the state before the first round, ``turn`` the state after a round and its largest
    miss of a goal; ``drop`` is told the states that are given up.
    """

    def tried(step: float) -> tuple[S, float, int]:
        state, offs = begin(step), []
        while not offs or offs[-1] > NEAR * whole:
            if len(offs) == rounds or len(offs) > STALL and min(offs[-STALL:]) > 0.9 * min(offs[:-STALL]):
                break
            state, off = turn(state)
            offs.append(off)
        return state, offs[-1], len(offs)

    found = tried(0.0)
    if found[1] > NEAR * whole:
        drop(found[0])
        low, high = 0.0, 1.0
        found = tried(high)
        for _ in range(steps):
            middle = (low + high) / 2
            new = tried(middle)
            if new[1] <= NEAR * whole:
                drop(found[0])
                high, found = middle, new
            else:
                drop(new[0])
                low = middle
    state, off, done = found
    while off > tolerance * whole and done < rounds:
        state, off = turn(state)
        done += 1
    return state


# -- raking in one task


def _scaled(tokens: np.ndarray, rate: np.ndarray, code: np.ndarray, goal: np.ndarray, turns: int = 100) -> np.ndarray:
    """Rates times the factor by value that meets ``goal``, cells capped at rate 1.

    Newton's method: a value's sum is concave in the factor, so a step from either side ends below the
    wanted factor, as does the factor that ignores the caps; the larger of both is taken. Steps from there only
    rise and end exactly. One step a round is enough for raking.
    """
    for _ in range(turns):
        full = rate >= 1 - SLACK
        part = rate * tokens
        taken, free, whole = (np.bincount(code, x, len(goal)) for x in (np.where(full, tokens, 0.0), np.where(full, 0.0, part), part))
        with np.errstate(divide="ignore", invalid="ignore"):
            below = np.where(whole > 0, goal / whole, 0.0)
            factor = np.maximum(np.where(free > 0, (goal - taken) / free, 0.0), below)
        factor = np.where((np.abs(goal - taken - free) <= SLACK * goal) | (free <= 0) & (taken < goal), 1.0, factor)
        rate = np.clip(rate * factor[code], *RANGE)
        if np.abs(factor[code] - 1).max(initial=0) < 1e-13:
            break
    return rate


def _off(tokens: np.ndarray, rate: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray]) -> float:
    expected = tokens * np.minimum(rate, 1)
    return max(float(np.abs(np.bincount(c, expected, len(g)) - g).max()) for c, g in zip(codes, goals, strict=True))


def _filled(asked: np.ndarray, most: np.ndarray, whole: float) -> np.ndarray:
    """Goals in the proportions asked that sum to ``whole``, none above ``most``: what one can't give is asked of the others."""
    goal, full = np.zeros(len(asked)), np.zeros(len(asked), bool)
    while True:
        free = asked[~full].sum()
        goal = np.where(full, most, asked * ((whole - most[full].sum()) / free if free > 0 else 0.0))
        over = ~full & (goal > most)
        if not over.any():
            return goal
        full |= over


def fitted(tokens: np.ndarray, codes: list[np.ndarray], asked: list[np.ndarray], budget: float, steps: int = STEPS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(probabilities, goals as shares): ``asked`` has the target shares by value of each dimension.

    Cells with a value whose target is 0 get nothing. Goals that the rest can't meet together are moved toward
    the shares it has, by the least step of a bisection that lets all be met.
    """
    use = np.ones(len(tokens), bool)
    for c, a in zip(codes, asked, strict=True):
        use &= a[c] > 0
    use &= tokens > 0
    out = np.zeros(len(tokens))
    have = [np.bincount(c[use], tokens[use], len(a)) for c, a in zip(codes, asked, strict=True)]
    there = float(tokens[use].sum())
    whole = min(budget * float(tokens.sum()), there)
    if whole <= 0:
        return out, [np.zeros(len(a)) for a in asked]
    wanted = [_filled(np.where(h > 0, a, 0), h, whole) for a, h in zip(asked, have, strict=True)]

    own, at = tokens[use].astype(float), [c[use] for c in codes]

    def begin(step: float) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.full(len(own), whole / there), [(1 - step) * w + step * h * (whole / there) for w, h in zip(wanted, have, strict=True)]

    def turn(state: tuple[np.ndarray, list[np.ndarray]]) -> tuple[tuple[np.ndarray, list[np.ndarray]], float]:
        rate, goals = state
        for c, g in zip(at, goals, strict=True):
            rate = _scaled(own, rate, c, g, 1)
        return (rate, goals), _off(own, rate, at, goals)

    rate, goals = _settled(begin, turn, lambda state: None, whole, steps)
    out[use] = np.minimum(rate, 1)
    return out, [g / whole for g in goals]


def _targets(values: Sequence[str], tokens: np.ndarray, given: Mapping[str, float] | None, flatten: float) -> np.ndarray:
    if given is None:
        share = np.where(tokens > 0, tokens.astype(float) ** flatten, 0.0)
    else:
        share = np.where(tokens > 0, [float(given.get(v, 0.0)) for v in values], 0.0)
    return share / share.sum() if share.sum() else share


def _in_one_task(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, float]] | None, budget: float, flatten: float, steps: int) -> DataFrame:
    kinds = ", ".join([*[f"{d} string" for d in dims], "tokens long, probability double", *[f"goal_{d} double" for d in dims]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([(d, "ascending") for d in dims]).combine_chunks()
        tokens = table.column("tokens").to_numpy()
        codes, asked = [], []
        for d in dims:
            coded = table.column(d).combine_chunks().dictionary_encode()
            values, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            codes.append(code)
            asked.append(_targets(values, np.bincount(code, tokens, len(values)), targets.get(d) if targets else None, flatten))
        probability, goals = fitted(tokens, codes, asked, budget, steps)
        columns = [*[table.column(d).combine_chunks() for d in dims], pa.array(tokens), pa.array(probability), *[pa.array(g[c]) for g, c in zip(goals, codes, strict=True)]]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in kinds.split(", ")])

    return cells.select(*dims, "tokens").repartition(1).mapInArrow(kernel, kinds)


# -- raking by aggregates, for more cells than a task should hold


def _level(values: DataFrame, whole: float) -> float:
    """s such that the sum of least(tokens, s * asked) over ``values`` is ``whole``."""
    s = 0.0
    while True:
        full = F.col("asked") * F.lit(s) >= F.col("tokens")
        taken, free = values.where("asked > 0").agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("asked")))).first()
        if not free:
            return max(s, 1e300)
        new = (whole - taken) / free
        if new <= s * (1 + 1e-12):
            return s
        s = new


def _by_aggregates(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, float]] | None, budget: float, flatten: float, steps: int) -> DataFrame:
    """As ``_in_one_task``, step by step, but that sums may differ in their last digits; no task holds a value's cells."""
    spark = cells.sparkSession
    marked = cells.select(*dims, "tokens")
    for d in dims:
        values = marked.groupBy(d).agg(F.sum("tokens").cast("double").alias("every"))
        share = F.pow("every", F.lit(float(flatten)))
        if targets and d in targets:
            values = values.join(spark.createDataFrame(list(targets[d].items()), f"`{d}` string, share double"), d, "left")
            share = F.coalesce("share", F.lit(0.0))
        marked = marked.join(values.select(d, F.when(F.col("every") > 0, share).otherwise(0.0).alias(f"asked_{d}")), d)
    used = F.col("tokens") > 0
    for d in dims:
        used &= F.col(f"asked_{d}") > 0
    marked = materialize(marked.withColumn("used", used), "mixing-used")
    total, there = (x or 0 for x in marked.agg(F.sum("tokens"), F.sum(F.when(F.col("used"), F.col("tokens")))).first())
    whole = min(budget * total, float(there))
    if whole <= 0:
        return cells.select(*dims, "tokens", F.lit(0.0).alias("probability"), *[F.lit(0.0).alias(f"goal_{d}") for d in dims])
    wanted = marked
    for d in dims:
        have = F.sum(F.when(F.col("used"), F.col("tokens")).otherwise(0)).cast("double")
        values = marked.groupBy(d).agg(have.alias("tokens"), F.first(f"asked_{d}").alias("asked")).withColumn("asked", F.when(F.col("tokens") > 0, F.col("asked")).otherwise(0.0))
        values = materialize(values, "mixing-values")
        goal = F.least(F.col("tokens"), F.lit(_level(values, whole)) * F.col("asked"))
        wanted = wanted.join(values.select(d, goal.alias(f"wanted_{d}"), F.col("tokens").alias(f"have_{d}")), d)
    base = materialize(wanted.drop(*[f"asked_{d}" for d in dims]), "mixing-wanted", replaces=marked)
    part, full = F.col("rate") * F.col("tokens"), F.col("rate") >= 1 - SLACK

    def begin(step: float) -> DataFrame:
        goals = [(F.col(f"wanted_{d}") * F.lit(1 - step) + F.col(f"have_{d}") * F.lit(step * (whole / there))).alias(f"goal_{d}") for d in dims]
        return base.select(*dims, "tokens", F.when(F.col("used"), F.lit(whole / there)).otherwise(0.0).alias("rate"), *goals)

    def turn(now: DataFrame) -> tuple[DataFrame, float]:
        new = now
        for d in dims:
            sums = new.groupBy(d).agg(
                F.first(f"goal_{d}").alias("goal"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(part)).alias("free"), F.sum(part).alias("whole")
            )
            below = F.when(F.col("whole") > 0, F.col("goal") / F.col("whole")).otherwise(0.0)
            step = F.when(F.col("free") > 0, (F.col("goal") - F.col("taken")) / F.col("free")).otherwise(0.0)
            reached = (F.abs(F.col("goal") - F.col("taken") - F.col("free")) <= SLACK * F.col("goal")) | ((F.col("free") <= 0) & (F.col("taken") < F.col("goal")))
            rate = F.greatest(F.least(F.col("rate") * F.col("factor"), F.lit(RANGE[1])), F.lit(RANGE[0]))
            new = new.join(sums.select(d, F.when(reached, 1.0).otherwise(F.greatest(step, below)).alias("factor")), d).withColumn("rate", F.when(F.col("rate") > 0, rate).otherwise(0.0)).drop("factor")
        new = materialize(new.select(now.columns), "mixing-rates", replaces=now)
        expected = F.col("tokens") * F.least("rate", F.lit(1.0))
        offs = [new.groupBy(d).agg(F.abs(F.sum(expected) - F.first(f"goal_{d}")).alias("off")).agg(F.max("off").alias("off")) for d in dims]
        return new, reduce(DataFrame.unionByName, offs).agg(F.max("off")).first()[0]

    def drop(state: DataFrame) -> None:
        remove(spark, state._table_path)

    last = _settled(begin, turn, drop, whole, steps)
    return last.select(*dims, "tokens", F.least("rate", F.lit(1.0)).alias("probability"), *[(F.col(f"goal_{d}") / F.lit(whole)).alias(f"goal_{d}") for d in dims])


def rake(cells: DataFrame, dims: Sequence[str] = DIMENSIONS, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, flatten: float = FLATTEN, most_cells: int = MOST_CELLS, steps: int = STEPS) -> DataFrame:
    """``cells(dims..., tokens)`` with ``probability`` and ``goal_<dim>``, the share that its value is given.

    Given targets are shares by value; values that they don't name get nothing, and they are scaled to sum
    to one over the values that have tokens. The expected tokens, tokens * probability, sum to ``budget`` of
    all, or to all that may be taken if those are fewer. A value's goal is its target, unless it has fewer
    tokens (then all are taken and the rest is asked of the others) or the goals can't be met together
    (then all move toward the shares that the cells have, as little as a bisection of ``steps`` steps finds to be enough); ``marginals`` tells them. Beyond
    ``most_cells`` the same rounds run as Spark jobs: the rules and the results don't depend on the number of cells.
    """
    if targets is not None:
        targets = {d: {str(value): float(share) for value, share in of.items()} for d, of in targets.items()}
    way = _in_one_task if cells.count() <= most_cells else _by_aggregates
    return way(cells, dims, targets, budget, flatten, steps)


def marginals(raked: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """``dimension, value, goal, expected, residual`` of raked cells; shares of the expected tokens."""
    expected = F.col("tokens") * F.col("probability")
    whole = raked.agg(F.sum(expected).alias("whole"))
    rows = None
    for d in dims:
        own = raked.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.max(f"goal_{d}").alias("goal"), F.sum(expected).alias("expected"))
        rows = own if rows is None else rows.unionByName(own)
    shares = rows.join(F.broadcast(whole)).withColumn("expected", F.coalesce(F.try_divide("expected", "whole"), F.lit(0.0)))  # one row
    return shares.select("dimension", "value", "goal", "expected", (F.col("expected") - F.col("goal")).alias("residual"))


def cells_of(marked: DataFrame, source: str, lang: str, topic: str, tokens: str) -> DataFrame:
    return materialize(marked.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(topic).alias("topic")).agg(F.sum(tokens).alias("tokens")), "mixing-cells")


def chosen(seed: int, probability: Column, *key: Column) -> Column:
    """A document is sampled if the hash of its key, as a number in [0, 1), is below its probability."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) * F.lit(2.0**-53) < probability


def _marked(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> tuple[DataFrame, Callable[[str], str]]:
    """``docs`` with source, lang, topic, tokens and draw under names that no column of it has."""
    name = fresh(docs, "source", "lang", "topic", "tokens", "draw", "made", "probability")
    out = docs.withColumn(name("made"), features(F.col(text_col)))
    topic = F.coalesce(F.col(topic_col).cast("string"), F.lit(MISSING)) if topic_col else F.col(f"{name('made')}.topic")
    return out.select(
        *[docs[c] for c in docs.columns], F.coalesce(F.col(source_col).cast("string"), F.lit(MISSING)).alias(name("source")), F.coalesce(F.col(lang_col).cast("string"), F.lit(MISSING)).alias(name("lang")),
        topic.alias(name("topic")), F.col(f"{name('made')}.tokens").alias(name("tokens")),
    ), name


def _with_probabilities(marked: DataFrame, name: Callable[[str], str], targets: Mapping[str, Mapping[str, float]] | None, budget: float) -> DataFrame:
    """Only cells are shuffled; their table is broadcast if Spark finds it small."""
    raked = rake(cells_of(marked, name("source"), name("lang"), name("topic"), name("tokens")), targets=targets, budget=budget)
    table = materialize(raked.select(*[F.col(d).alias(name(d)) for d in DIMENSIONS], F.col("probability").alias(name("probability"))), "mixing-probabilities")
    return marked.join(table, [name(d) for d in DIMENSIONS], "left").withColumn(name("probability"), F.coalesce(name("probability"), F.lit(0.0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """One row per document: ``id, source, lang, topic, n_tokens, probability, sampled``.

    A null source, language or topic is a value of its own, ``(none)``; null and empty texts have no token.
    Documents of cells without any token have probability 0. Rows that repeat id and text share their
    decision; null ids are told apart by their texts. Very long texts are looked at one Arrow batch at a
    time. Other columns, whatever their names, are ignored. Empty in, empty out.
    """
    ready(docs)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("s"), F.col(lang_col).alias("l"), *([F.col(topic_col).alias("t")] if topic_col else []))
    marked, name = _marked(own, "text", "s", "l", "t" if topic_col else None)
    marked = materialize(marked.withColumn(name("draw"), F.xxhash64("text")).drop("text", "s", "l", "t"), "mixing-features")
    found = _with_probabilities(marked, name, targets, budget)
    p = F.col(name("probability"))
    return found.select(
        F.col("id").alias(id_col), F.col(name("source")).alias("source"), F.col(name("lang")).alias("lang"), F.col(name("topic")).alias("topic"),
        F.col(name("tokens")).alias("n_tokens"), p.alias("probability"), chosen(seed, p, F.col("id"), F.col(name("draw"))).alias("sampled"),
    )


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """The sampled documents with all their columns, as ``mix`` decides, then what of ``topic``, ``n_tokens`` and ``probability`` they don't have yet."""
    ready(docs)
    marked, name = _marked(docs, text_col, source_col, lang_col, topic_col)
    found = _with_probabilities(marked, name, targets, budget)
    p = F.col(name("probability"))
    more = {"topic": name("topic"), "n_tokens": name("tokens"), "probability": name("probability")}
    taken = {c.lower() for c in docs.columns}
    found = found.where(chosen(seed, p, F.col(id_col), F.xxhash64(F.col(text_col))))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(v).alias(k) for k, v in more.items() if k not in taken])
