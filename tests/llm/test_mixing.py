"""Raking under caps, and sampling by its probabilities."""

import numpy as np
import pytest

from lathework.llm import mixing

CELLS = [(s, g, t, 10 + 7 * i * j + k) for i, s in enumerate("abc") for j, g in enumerate("xy") for k, t in enumerate("pq")] + [("z", "x", "p", 0)]
SCHEMA = "source string, lang string, topic string, tokens long"


def shares(rows, d):
    whole = sum(r.tokens * r.probability for r in rows)
    return {v: sum(r.tokens * r.probability for r in rows if r[d] == v) / whole for v in {r[d] for r in rows}}


@pytest.mark.parametrize("most_cells", [1000, 0])
def test_raking_meets_marginals(spark, most_cells):
    """In one task and by windows; probabilities are capped and the marginals still met."""
    targets = {"source": {"a": 0.3, "b": 0.3, "c": 0.4}, "lang": {"x": 0.45, "y": 0.55}, "topic": {"p": 0.4, "q": 0.6}}
    got = mixing.rake(spark.createDataFrame(CELLS, SCHEMA), targets=targets, budget=0.7, most_cells=most_cells).collect()
    assert len(got) == len(CELLS) and all(0 <= r.probability <= 1 for r in got) and any(r.probability == 1 for r in got)
    for d, want in targets.items():
        found = shares(got, d)
        assert all(abs(found[v] - share) < 1e-3 for v, share in want.items())
    assert abs(sum(r.tokens * r.probability for r in got) - 0.7 * sum(r.tokens for r in got)) < 0.05
    told = {(r.dimension, r.value): r for r in mixing.marginals(spark.createDataFrame(got)).collect()}
    assert all(abs(told[d, v].goal - share) < 1e-3 and abs(told[d, v].residual) < 1e-3 for d, want in targets.items() for v, share in want.items())


@pytest.mark.parametrize("most_cells", [1000, 0])
def test_targets_beyond_what_is_there(spark, most_cells):
    """A value that is asked for more than it has is taken whole; excluded values give nothing."""
    cells = spark.createDataFrame([("a", "x", "p", 900), ("b", "x", "p", 90), ("c", "y", "p", 10), ("c", "x", "q", 500)], SCHEMA)
    got = {(r.source, r.lang, r.topic): r.probability for r in mixing.rake(cells, targets={"source": {"a": 0.5, "b": 0.5}}, budget=0.2, most_cells=most_cells).collect()}
    assert got[("c", "y", "p")] == got[("c", "x", "q")] == 0 and got[("b", "x", "p")] > 0.999
    assert abs(got[("a", "x", "p")] * 900 + 90 - 300) < 1
    everything = mixing.rake(cells, budget=1.0, most_cells=most_cells).collect()
    assert all(abs(r.probability - 1) < 1e-3 for r in everything)
    assert all(r.probability == 0 for r in mixing.rake(cells, targets={"lang": {"none": 1.0}}, most_cells=most_cells).collect())
    assert mixing.rake(cells.limit(0), most_cells=most_cells).collect() == []


@pytest.mark.parametrize("conflict", [False, True])
def test_both_ways_give_the_same(spark, conflict):
    """In one task and by aggregates: every probability and goal, with excluded values, empty cells and goals that conflict."""
    if conflict:
        rows, more = [("a", "x", "p", 100), ("b", "x", "p", 1), ("b", "y", "p", 100)], {"targets": {"source": {"a": 0.1, "b": 0.9}, "lang": {"x": 0.9, "y": 0.1}}, "budget": 0.4, "steps": 1}
    else:
        rows, more = [*CELLS, ("d", "x", "p", 5000), ("d", "v", "p", 0)], {"targets": {"source": {"a": 0.3, "b": 0.3, "c": 0.4}}, "budget": 0.03}
    one, many = (sorted(mixing.rake(spark.createDataFrame(rows, SCHEMA), most_cells=most, **more).collect()) for most in (1000, 0))
    assert len(one) == len(many) == len(rows) and 0 < sum(r.tokens * r.probability for r in one)
    assert [r[:4] for r in one] == [r[:4] for r in many] and np.allclose([r[4:] for r in one], [r[4:] for r in many], rtol=0, atol=1e-9)


def test_capped_scaling_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        tokens, rate, code = rng.integers(1, 100, n).astype(float), rng.random(n) * 2, rng.integers(0, 4, n)
        have = np.bincount(code, tokens, 4)
        goal = have * rng.random(4)
        new = mixing._scaled(tokens, rate, code, goal)
        assert np.allclose(np.bincount(code, tokens * np.minimum(new, 1), 4), goal)
        for v in range(4):
            own = (code == v) & (rate > 0)
            assert own.sum() < 2 or np.ptp(new[own] / rate[own]) < 1e-6 * max(1, (new[own] / rate[own]).max())


def test_joint_goals_that_conflict_move_together():
    tokens = np.array([100, 1, 100])  # (a, x), (b, x), (b, y): b's goal needs y, x's goal needs a
    codes = [np.array([0, 1, 1]), np.array([0, 0, 1])]
    p, goals = mixing.fitted(tokens, codes, [np.array([0.1, 0.9]), np.array([0.9, 0.1])], 0.4)
    got = tokens * p / (tokens * p).sum()
    assert abs(got[0] - goals[0][0]) < 2e-3 and abs(got[2] - goals[1][1]) < 2e-3 and abs((tokens * p).sum() - 0.4 * 201) < 0.2


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_documents(spark, sf):
    """The table's own shares, counted apart, are within one percent of the goals; the sample follows the probabilities."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(text) and all(0 <= r.probability <= 1 and r.n_tokens == len(text[r.doc_id].encode().split()) for r in got)
    cells = {}
    for r in got:
        key = (r.source, r.lang, r.topic)
        cells[key] = (cells.get(key, (0, 0))[0] + r.n_tokens, r.probability)
    rows = [(*k, t, p) for k, (t, p) in cells.items()]
    raked = mixing.rake(spark.createDataFrame([r[:4] for r in rows], SCHEMA))
    told = mixing.marginals(raked).collect()
    whole = sum(t * p for *_, t, p in rows)
    assert abs(whole - 0.5 * sum(r[3] for r in rows)) < 0.005 * whole
    for m in told:
        own = sum(t * p for *k, t, p in rows if k[mixing.DIMENSIONS.index(m.dimension)] == m.value) / whole
        assert abs(own - m.goal) < 0.01 and abs(own - m.expected) < 1e-6
    kept = mixing.sample(docs)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.sampled} and kept.columns[:5] == docs.columns


def test_odd_documents(spark):
    odd = spark.createDataFrame([(1, None, None, "en"), (None, "a b", "s", None), (1, "a b c", "s", "en"), (1, "a b c", "s", "en"), (2, "\t\n ", "s", "en")], "doc_id long, text string, source string, lang string")
    rows = {(r.doc_id, r.source, r.lang, r.n_tokens) for r in mixing.mix(odd).collect()}
    assert rows == {(1, "(none)", "en", 0), (None, "s", "(none)", 2), (1, "s", "en", 3), (2, "s", "en", 0)}
    assert mixing.mix(odd.limit(0)).collect() == [] and mixing.sample(odd.limit(0)).collect() == []
    assert len(mixing.sample(odd, budget=1.0).collect()) == 3
    # names that inner or added columns have stay the caller's
    clash = odd.selectExpr("*", "'mine' as topic", "7 as probability", "1 as _source", "2 as _tokens", "3 as _Made", "4 as n_tokens")
    kept = mixing.sample(clash, budget=1.0)
    assert kept.columns == clash.columns and {(r.topic, r.probability, r._source, r._tokens, r._Made, r.n_tokens) for r in kept.collect()} == {("mine", 7, 1, 2, 3, 4)}
    # a column of topics instead of forms; a very long text
    long = spark.createDataFrame([(1, "word " * 2_000_000, "s", "en", "t1"), (2, "b", "s", "en", None)], "doc_id long, text string, source string, lang string, kind string")
    assert {(r.doc_id, r.topic, r.n_tokens) for r in mixing.mix(long, topic_col="kind").collect()} == {(1, "t1", 2_000_000), (2, "(none)", 1)}
    # thousands of rows without an id are not all drawn or all left
    many = mixing.mix(spark.createDataFrame([(None, f"text {i}", "s", "en") for i in range(2000)], odd.schema)).collect()
    assert 800 < sum(r.sampled for r in many) < 1200


def test_forms():
    texts = ["", "a | b | c", "SHOUTING LOUD", "1 2 3 4 5", "line\nline\n", "plain prose that goes on and on"]
    raw = "".join(texts).encode()
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    tokens, form = mixing.forms(np.frombuffer(raw, np.uint8), off)
    assert [mixing.FORMS[i] for i in form] == ["empty", "table", "shouting", "data", "listing", "prose"]
    assert tokens.tolist() == [len(t.split()) for t in texts]
