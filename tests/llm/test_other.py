"""Search, mixing, WARC, and the pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import ann, queries, warc
from lathework.llm.common import components, new_path

DATA = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 60)] + [(100, 105), (105, 103), (7, 7), (None, 3), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 103: 100, 105: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_search_recall_and_contract(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    rows = df.collect()
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    hit = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {i for i in x if i % 20 == 0}
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - x[q] @ x[v]) < 1e-12 for _, v, s in found) and all(v != q for _, v, _ in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        truth = sorted(((-(x[q] @ x[v]), v) for v in x if v != q))[:20]
        hit += len({v for _, v in truth} & {v for _, v, _ in found})
        total += 20
    assert hit / total >= 0.9


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (20, [2.0, 0.0]), (20, [2.0, 0.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cells string")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0] == [(1, 20, 2.0), (2, 1, 1.0), (3, 100, 1.0)]
    assert [(r["rank"], r.vec_id) for r in got if r.query_id == 20] == [(1, 0), (2, 1), (3, 100)]
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []
    assert ann.search(df.limit(0), F.lit(True)).collect() == []
    few = ann.search(df.where("vec_id in (0, 7)"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 7)]


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(9, 3)), rng.normal(size=(7, 3))
    index = ann.Index(left, right, rng.integers(0, 3, (9, 7)), 1.0)
    q = rng.normal(size=6)
    walked = index.walk(q, 10**9)
    near = {(i, j): -(left[i] @ q[:3]) - (right[j] @ q[3:]) for i in range(9) for j in range(7) if index.counts[i, j]}
    assert walked == sorted(near, key=near.get)


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_warc_round_trip(spark):
    long = "é<p>" * 40
    fake = "text\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nmore " + "WARC/1.1 " * 20
    rows = [(5, "u", long), (3, None, long), (9, "u\r\nX: y", long), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", fake), (10, "u", fake), (None, "u", long), (11, "u", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    first = {digest(long): 3, digest(fake): 8}
    want = []
    for i, _, t in rows:
        n, d = len((t or "").encode()), digest(t)
        again = n >= 100 and first.get(d) != i
        want.append((i or -1, n, d, "revisit" if again else "response", first[d] if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_chain_rejects_magic_in_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    df = spark.createDataFrame([(i, "u", fake * 3) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(df, new_path(spark, "t"), compression="none")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    edges = warc.candidates(files)
    assert edges.count() > 30
    assert sorted(r.id for r in warc.reachable(edges).collect()) == sorted(str(i) for i in range(30))
    assert warc._candidate(b"WARC/1.1 no header", 0)[0] is None


def test_pointer_jumping_against_a_walk():
    rng = np.random.default_rng(8)
    for n in (1, 2, 50, 3000):
        at = np.unique(np.append(0, rng.integers(0, 10 * n, n)))
        after = np.where(rng.random(len(at)) < 0.9, at[np.minimum(np.arange(len(at)) + rng.integers(1, 4, len(at)), len(at) - 1)], rng.integers(-1, 10 * n, len(at)))
        walk, here = set(), 0
        of = dict(zip(at.tolist(), after.tolist(), strict=True))
        while here in of and here not in walk:
            walk.add(here)
            here = of[here] if of[here] > here else -1
        assert set(at[warc.on_chain(at, after)].tolist()) == walk


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "CLASSES", (2_000, 10_000))
    rows = [(i, "u", "x" * n + str(i)) for i, n in enumerate([10] * 40 + [4_000] * 9 + [30_000, 50_000])]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(df, new_path(spark, "t"), compression="none")
    sizes = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    assert sum(n > 20_000 for n in sizes) == 2 and sum(sizes) > 100_000
    got = warc.round_trip(df.selectExpr("*", "1 as size", "2 as file", "3 as `next`")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted((i, len(t)) for i, _, t in [*rows, rows[0]])


def test_parts_hold_cells(monkeypatch):
    """Parts are numbered in turn, no cell shares one with a cell that has several, and none holds much more than a block."""
    monkeypatch.setattr(ann, "BLOCK", 10)
    rng = np.random.default_rng(2)
    for counts in (rng.integers(0, 9, (5, 30)), rng.integers(0, 45, (5, 30)), np.array([[0, 0, 35, 3, 2, 0, 12]])):
        index = ann.Index(np.zeros((len(counts), 1)), np.zeros((counts.shape[1], 1)), counts, 1.0)
        for i, row in enumerate(counts):
            load = {}
            for j, n in enumerate(row):
                parts = range(index.first_part[i, j], index.first_part[i, j] + index.parts[i, j])
                assert len(parts) == max(1, -(-n // 10))
                for p in parts:
                    load.setdefault(p, []).append((j, n / len(parts)))
            assert sorted(load) == list(range(len(load)))
            assert all(sum(n for _, n in cells) <= 20 and (len(cells) == 1 or all(row[j] <= 10 for j, _ in cells)) for cells in load.values())


def test_search_is_the_same_in_small_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(1000 + i, [1.0] * 8) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, codewords=3).collect())
    monkeypatch.setattr(ann, "BLOCK", 16)
    assert sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, codewords=3).collect()) == whole and len(whole) == 20 * 31


def test_search_keeps_doubles(spark):
    rows = [(0, [0.1, 0.7]), (1, [1.0, 0.1]), (2, [1e200, 1e-3])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 0.1 * 1e200 + 0.7 * 1e-3), (1, 0.1 * 1.0 + 0.7 * 0.1)]


def test_pipeline_against_brute_force(spark):
    """Each stage against a plain version of it, over what its predecessor kept."""
    import brute
    import corpus_pipeline

    from lathework.llm import langid, mixing, secret_scan

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    near = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    now = stages["language_id"](spark, docs, DATA).cache()
    got = {r.doc_id: r for r in now.collect()}
    assert set(got) == {i for i, r in near.items() if not r.rejected} and all(got[i].lang == near[i].lang_pred and got[i].text == rows[i].text for i in got)

    def shingles(text):
        w = [x.lower() for x in brute.WORD.findall(text or "")]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(r.text) for i, r in got.items()}, {i: i for i in got}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    now = stages["near_duplicates"](spark, now, DATA).cache()
    assert {r.doc_id for r in now.collect()} == {i for i in sets if top(i) == i}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hits = brute.benchmark_hits([(r.doc_id, r.text) for r in now.collect()], items)
    now = stages["decontamination"](spark, now, DATA).cache()
    assert {r.doc_id for r in now.collect()} == {i for i, h in hits.items() if not h[4]}

    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in secret_scan.scan_secrets(now).collect()}
    want = {}
    for r in now.collect():
        text, gone = r.text, np.zeros(len(r.text) + 1, bool)
        edges = set()
        for a, e in spans[r.doc_id]:
            edges.add(a) if not gone[a] else None
            gone[a:e] = True
        want[r.doc_id] = "".join("[SECRET]" * (k in edges) + (c if not gone[k] else "") for k, c in enumerate(text))
    now = stages["secret_scan"](spark, now, DATA).cache()
    assert {r.doc_id: r.text for r in now.collect()} == want and all(r.n_chars == len(r.text) for r in now.collect() if "[SECRET]" in r.text)

    decided = {r.doc_id: r for r in mixing.mix(now).collect()}
    last = {r.doc_id: r for r in stages["source_mixing"](spark, now, DATA).collect()}
    assert set(last) == {i for i, r in decided.items() if r.sampled} and all(abs(last[i].probability - decided[i].probability) < 1e-12 for i in last)
    assert {r.doc_id: r.text for r in corpus_pipeline.run(spark, DATA).collect()} == {i: r.text for i, r in last.items()}


def test_pipeline_stages_take_odd_tables(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns whose names clash, and nothing at all."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    long = "the house of the man is in the town and the " * 30_000
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (None, "the town is near the house and the man is there", None, "s", 5), (2, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (2, long + " x", "en", None, None)], docs.schema)
    every = docs.unionByName(odd).selectExpr("*", "'mine' as _letter", "1 as _row", "2 as _text", "3 as _base", "4 as _spans", "5 as _source", "6 as _tokens", "'t' as topic", "8 as row")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        every = stage(spark, every, DATA).cache()
        kept[name] = every.count()
        assert every.columns[:14] == [*docs.columns, "_letter", "_row", "_text", "_base", "_spans", "_source", "_tokens", "topic", "row"]
        assert every.where("_letter <> 'mine' or _row <> 1 or _text <> 2 or _base <> 3 or _spans <> 4 or _source <> 5 or _tokens <> 6 or topic <> 't' or row <> 8").count() == 0
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert kept["language_id"] <= 64 and kept["near_duplicates"] <= kept["language_id"] - 2


def test_queries_and_pipeline(spark):
    import corpus_pipeline

    made = queries.queries()
    assert [n.split("_")[0] for n in made][:10] == [f"op{i}" for i in range(1, 11)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        assert out.count() <= before and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert name == "source_mixing" or len(out.columns) == 5
        before, docs = out.count(), out
    run = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in run.collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, DATA)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
