"""SimHash, window and suffix-array dedup against brute force, over awkward documents."""

import random

import brute
import numpy as np
import pytest

from lathework.llm import near_copies, simhash, suffix, suffix_dedup, window_dedup

DOCS = "doc_id long, text string, key string, id int"  # columns whose names clash with inner ones


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(brute.texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOCS).repartition(3)


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 200, 1500):
        for letters in (1, 2, 30):
            data = rng.integers(65, 65 + letters, n).astype(np.uint8)
            if n >= 200:
                data = np.concatenate((data, data[:150], data))
            text = data.tobytes()
            want = sorted(range(len(text)), key=lambda i: text[i:])
            sa, _ = suffix.of_bytes(data)
            assert sa.tolist() == want
            tokens, _ = suffix.of_tokens(data.astype(np.int32))
            assert tokens.tolist() == want

            def common(i, j):
                k = 0
                while k < 90 and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                return k

            assert suffix.kasai(data, sa, 90).tolist() == ([0] + [common(want[i - 1], want[i]) for i in range(1, len(want))])[: len(want)]


def test_golay_keys_meet_within_three_bits():
    table, _ = simhash.segment_keys()
    rng = random.Random(3)

    def keys(x):
        s = [x >> 16 * i & 0xFFFF for i in range(4)]
        return {(c, s[c], int(k)) for c in range(4) for k in table[s[(c + 1) % 4]] if k >= 0}

    for _ in range(3000):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        assert keys(a) & keys(b)
    index = np.arange(1 << 12)
    words = index << 11 ^ simhash._syndromes(index << 11)  # all codewords
    for error in (0, 1 << 22, 1 << 3 | 1 << 17, 0b111):
        assert (simhash.golay_index(words ^ error) == index).all()


def test_simhash(spark, docs, rows):
    near = [(100 + i, brute.passage(50) + f" {'w' * i}") for i in range(30)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(every).collect()}
    prints = {i: brute.simhash(t) for i, t in [*rows, *near]}
    roots = brute.components(prints)
    assert got == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


def test_links_span_dense_groups(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {0: centre}
    for i in range(1, 400):
        x = rng.choice(list(prints.values()))
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << bit
        prints[i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    back = {signed(p): p for p in prints.values()}
    edges = simhash.links(spark.createDataFrame([(k,) for k in back], "fp long")).collect()
    assert all((back[e.a] ^ back[e.b]).bit_count() <= 3 for e in edges)
    roots = brute.components(back)
    from lathework.llm.common import components

    found = {r.node: r.root for r in components(spark.createDataFrame([(e.a, e.b) for e in edges], "a long, b long")).collect()}
    assert {k: found.get(k, k) for k in back} == roots


def test_simhash_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, None), (9, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 5), (5, 5), (5, 5), (7, 7), (9, 7)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    assert sorted(r.doc_id or -1 for r in simhash.keep_first(df).collect()) == [-1, 5, 7]


@pytest.mark.parametrize("chunk", [window_dedup.CHUNK, 1900])
def test_windows(docs, rows, chunk):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in window_dedup.remove_repeated_windows(docs, chunk=chunk).collect()}
    assert got == brute.windows(rows)


@pytest.mark.parametrize("chunk", [suffix_dedup.CHUNK, 1900])
def test_strings(docs, rows, chunk):
    """A small chunk cuts the longer texts."""
    found = suffix_dedup.remove_repeated_strings(docs, chunk=chunk).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute.strings(rows)
    assert {r.doc_id: r.n_repeated for r in found} == {i: x[1] for i, x in brute.strings(rows, 240).items()}


def test_short_passages_are_reported(spark):
    """Repeated passages between the two lengths are told, not removed; shorter ones are neither."""
    rows = []
    for i, n in enumerate((150, 239, 240, 280, 399, 400, 450)):
        shared = brute.passage(500 + i, 120)[:n].replace(" ", "-")
        rows += [(10 * i + k, f"{brute.passage(600 + 10 * i + k, 80)} {k}{shared}{k} {brute.passage(700 + 10 * i + k, 80)}") for k in (0, 1)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, n in enumerate((150, 239, 240, 280, 399, 400, 450)):
        for k in (0, 1):
            assert (got[10 * i + k].n_removed, got[10 * i + k].n_repeated) == (n if n >= 400 else 0, n if n >= 240 else 0)


def test_strings_across_shards():
    pieces = list({brute.passage(9, 400)[i : i + 700].encode() for i in range(0, 1500, 37)} | {brute.passage(11, 120).encode(), b"q" * 900})
    strings = [max(0, len(p) - 399) if i % 3 else max(0, len(p) - 239) for i, p in enumerate(pieces)]
    whole = suffix_dedup.repeated_strings(pieces, strings)
    small = suffix_dedup.repeated_strings(pieces, strings, shard=1500)
    for n, which in ((240, 0), (400, 1)):
        owned = [p[k : k + n] for p, s in zip(pieces, strings, strict=True) for k in range(s) if k + n <= len(p)]
        for p, s, a, b in zip(pieces, strings, whole, small, strict=True):
            want = [k + n <= len(p) and owned.count(p[k : k + n]) > 1 for k in range(s)]
            assert a[which].tolist() == want and b[which].tolist() == want


@pytest.mark.parametrize("operator", [window_dedup.remove_repeated_windows, suffix_dedup.remove_repeated_strings])
def test_dedup_nulls_repeats_and_nothing(spark, operator):
    long = brute.passage(8, 150)
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (None, long), (2, long + " x"), (2, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_removed) for r in operator(df).collect())
    assert len(got) == 6 and operator(df.limit(0)).collect() == []
    first = 0 if operator is window_dedup.remove_repeated_windows else len(long)
    size = 150 if operator is window_dedup.remove_repeated_windows else len(long)
    assert got == sorted([(1, first), (1, first), (2, 0), (99, size), (2, size), (2, 0)])


def edited(text, changes):
    """``text`` with evenly spread words replaced: each takes five shingles of one word away."""
    words = text.split()
    for i in range(changes):
        words[5 + i * (len(words) - 10) // changes] = f"changed{i}"
    return " ".join(words)


def test_keep_first_links_by_jaccard(spark):
    """Texts of similarity 0.8 to 0.97 are linked, however many bits apart; those below 0.8 are not."""
    rows = []
    for i in range(40):
        text = brute.passage(1000 + i, 300)
        rows += [(10 * i, text), (10 * i + 1, edited(text, 1 + i % 6)), (10 * i + 2, edited(text, 9)), (10 * i + 3, edited(text, 12))]
    sets = {d: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}
    for block in range(40):
        own = [10 * block + k for k in range(4)]
        for _ in own:
            for a in own:
                for b in own:
                    if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
    want = {d for d, r in root.items() if d == r}
    assert 40 < len(want) < len(rows)
    assert {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == want


def test_keep_first_finds_all_within_three_bits(spark, monkeypatch):
    """SimHash and its Golay keys alone, without MinHash: similar texts within three bits are linked, others aren't."""
    texts, far = [], None
    for i in range(30):
        words = [f"w{i}x{k}" for k in range(400)]
        texts += [" ".join(words[:k] + ["new"] * min(1, k) + words[k:]) for k in (0, 90, 300)] + [" ".join(words[: 390 - i])]
    bits = lambda t: simhash.bits(near_copies.shingle_set(t.encode()))
    for i in range(20_000):  # a pair within three bits that is not similar enough
        words = [f"v{i}x{k}" for k in range(34)]
        far = (" ".join(words), " ".join([*words[:29], "a", "b", "c", "d", "e"]))
        if (bits(far[0]) ^ bits(far[1])).bit_count() <= 3:
            break
    rows = list(enumerate([*texts, *far]))
    sets = {i: set(near_copies.shingle_set(t.encode()).tolist()) for i, t in rows}
    group = brute.components({i: bits(t) for i, t in rows})
    assert group[len(texts)] == group[len(texts) + 1] and len(set(group.values())) < 80
    root = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if group[a] == group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    monkeypatch.setattr(near_copies, "candidates", lambda prints: prints.selectExpr("print a", "print b").limit(0))
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i for i, r in root.items() if i == r} and {len(texts), len(texts) + 1} <= got


def test_keep_first_leaves_the_callers_columns(spark):
    rows = [(1, "a b c", "r", 1, 2), (1, "a b c", "r", 1, 2), (2, "a b c", "r", 1, 2), (3, None, "r", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, row int, print int")
    assert sorted(tuple(r) for r in simhash.keep_first(df).collect()) == [(1, "a b c", "r", 1, 2), (3, None, "r", 1, 2)]
    assert simhash.keep_first(df).columns == df.columns and simhash.near_duplicates(df.withColumn("fp", df.row)).count() == 4


def test_keep_first_tells_texts_of_one_id_apart(spark):
    a, b = brute.passage(21, 100), brute.passage(22, 100)
    rows = [(3, a), (3, b), (3, b), (3, edited(b, 1)), (4, a), (2, edited(a, 1)), (None, b), (5, brute.passage(23)), (5, brute.passage(24))]
    got = [(r.doc_id, r.text) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 5 and sum(i == 5 for i, _ in got) == 2 and (2, edited(a, 1)) in got and (None, b) in got
    assert [t for i, t in got if i == 3][0] in (b, edited(b, 1))
