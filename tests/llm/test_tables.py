"""Operators that compare rows: op2, op7, op8, op9, op10, and the registered queries."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest
from helpers import documents, stored_documents
from pyspark.sql import functions as F

from quire.llm import extraction, ngram_join, substrings, vectors, warc
from quire.llm.common import Scratch
from quire.llm.components import components

rng = random.Random(9)
SF_DIR = os.environ.get("QUIRE_TEST_SF_DIR", "/root/testdata/sf0.001")


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(30)] + [
        (rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    pairs = [(a, b) for a, b in pairs if a != b]
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint"), Scratch(spark))
    nodes = {n for p in pairs for n in p}
    assert {r.node: r.root for r in found.collect()} == groups_of(pairs, nodes)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).count() == 0


def test_archives(spark, tmp_path):
    long = "<p>" + "long é " * 400
    rows = [(1, "u\nv", long), (2, None, None), (3, "w", "short"), (4, "w", "short"), (9, "x", long), (5, "y", long),
            (9, "x", long), (None, "z", long)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    place = str(tmp_path / "archives")
    manifest = warc.write_archives(df, place, roll_bytes=200, task_bytes=4000)
    assert manifest.count() > 3 and sum(r.records for r in manifest.collect()) == len(rows)
    got = warc.read_archives(spark, place, payloads=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {2: "", 3: "short", 4: "short"}.get(r.page_id, long).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(text), hashlib.sha1(text).hexdigest())
        first = r.page_id in (2, 3, 4, 9)
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", 9))
        assert bytes(r.payload) == text if first else r.payload is None
    warc.write_archives(df, place + "2", roll_bytes=200, task_bytes=4000)
    names = sorted(f for f in os.listdir(place) if f.endswith(".gz"))
    for name in names:
        assert open(f"{place}/{name}", "rb").read() == open(f"{place}2/{name}", "rb").read()
    assert warc.archive_report(df.limit(0)).count() == 0
    wrong = spark.read.parquet(place + "/_manifest").withColumn("sha1", F.lit("0" * 40)).collect()
    spark.createDataFrame(wrong, warc.MANIFEST).write.mode("overwrite").parquet(place + "/_manifest")
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read_archives(spark, place).collect()


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p", ""),
    ("<html><head><title>T</title></head><body><nav>m</nav><header>h</header><article><h1>A &amp; B</h1><p>One<br>two"
     "<p><b>three</b> \n four<script>var x='</p>'</script><aside>no</aside><div class='comments'><p>me</p></div></article>"
     "<div class=ad>buy</div><footer>f</footer>", "A & B\nOne two\nthree four"),
    ("<body class='has sidebar'><div id=menu><a>x</a></div><div><h2>Head</h2><p>A long sentence, with commas, and more "
     "of it here.</p><p>Another long sentence, that goes on for a while.</p></div><form><p>mail</p></form>",
     "Head\nA long sentence, with commas, and more of it here.\nAnother long sentence, that goes on for a while."),
    ("<main><ul><li>a<li>b</ul><p>" + "<div>" * 3000 + "deep", "a\nb\ndeep"),
])
def test_main_text(html, text):
    assert extraction.main_text(html) == text


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x</article>", "old")], "page_id int, url string, html string, text string")
    assert [tuple(r) for r in extraction.extract(df).collect()] == [(1, "u", "<article><p>x</article>", "x")]


def near_copies():
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(n)] for n in (30, 80, 200, 15)]
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "a"), (4, "one", "a"), (5, "ONE", "a"), (6, "a b", "a"), (7, "a b c", "a")]
    for k in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
            words[rng.randrange(len(words))] = rng.choice(("new", "other", "third"))
        rows.append((100 + k, rng.choice((" ", "\n", "  ")).join(words), "a"))
    return [*rows, (None, "one", "a"), (None, "alone here it is", "a"), (100, rows[7][1], "a"), (100, rows[9][1], "a")]


@pytest.mark.parametrize("hot", [2, 32])
def test_near_duplicates(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_BUCKET", hot)
    rows = near_copies()
    df = stored_documents(spark, tmp_path, rows)
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for size, percent in ((3, 90), (5, 80)):
        sets = []
        for _, text, _ in rows:
            w = (text or "").encode().translate(lower).split()
            sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i]
                 and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        root = groups_of(pairs, range(len(sets)))
        expected = []
        for i, (key, _, _) in enumerate(rows):
            keys = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
            expected.append((key, len(sets[i]), min(keys, default=None)))
        got = ngram_join.near_duplicates(df, size=size, percent=percent).collect()
        assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, expected))
        kept = ngram_join.without_near_duplicates(df, size=size, percent=percent)
        assert kept.columns == df.columns
        assert kept.count() == len({root[i] for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)
    assert ngram_join.join_report(df.limit(0)).count() == 0


def test_repeats(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, None, "a"), (2, "", "a"), (3, f"x y {passage} z", "a"), (8, f"q {passage} r\n{passage}", "a"),
            (9, " ".join(f"p{k}" for k in range(5, 18)), "a"), (None, passage, "a"), (3, passage, "a"),
            (10, " ".join(f"p{k}" for k in range(5, 17)), "a"), (11, "and " * 3000, "a"), (12, "and " * 20, "a"),
            *[r for r in near_copies() if r[0] and r[0] >= 100]]
    last = float("inf")
    split = [(last if k is None else k, (t or "").encode().split()) for k, t, _ in rows]
    low = {}
    for key, w in split:
        for i in range(len(w) - 12):
            low[tuple(w[i : i + 13])] = min(low.get(tuple(w[i : i + 13]), last), key)
    expected = []
    for (key, w), (shown, _, _) in zip(split, rows, strict=True):
        gone = set()
        for i in range(len(w) - 12):
            if low[tuple(w[i : i + 13])] < key:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((shown, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    df = documents(spark, rows)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeat_report(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    cleaned = substrings.remove_repeats(df)
    assert sorted(cleaned.columns) == sorted(df.columns)
    texts = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in cleaned.collect())
    assert texts == sorted(e[3] for e in expected)
    assert substrings.repeat_report(df.limit(0)).count() == 0


def test_vectors_of_many_lengths_and_sizes(spark):
    made = np.random.default_rng(5)
    rows = []
    for size in range(1, 71):
        base = made.normal(size=size)
        rows += [(len(rows), base.tolist()), (len(rows) + 1, (base * 3).tolist()), (len(rows) + 2, (-base).tolist())]
    rows += [(1000, [1e300, 1e-300]), (1001, [2e300, 0.0]), (1002, [1e-300, 1e300]), (1003, [0.0, 5e-324]), (1004, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    for k in range(0, 210, 3):
        # One-dimensional and two-dimensional vectors may meet others of their length only.
        assert got[k + 1][1] == got[k][1] and got[k][0] >= 1
    assert got[3 * 69] == (1, 207) and got[3 * 69 + 2] == (0, 209)
    assert got[1000][1] == got[1001][1] and got[1002][1] == got[1003][1] and got[1004] == (0, 1004)


@pytest.mark.parametrize("tile, rare", [(7, 0), (16_384, 0), (7, 2048)])
def test_near_vectors(spark, monkeypatch, tile, rare):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "RARE_LENGTH", rare)
    made = np.random.default_rng(4)
    centers = made.normal(size=(6, 16))
    rows = [(i, (centers[i % 6] + made.normal(size=16) * made.choice([0.02, 0.2])).astype("float32").tolist()) for i in range(60)]
    rows += [(60 + i, made.normal(size=16).astype("float32").tolist()) for i in range(60)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] * 16), (204, []),
             (205, [float("inf")] + [1.0] * 15), (206, [1.0, 2.0]), (207, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id bigint, embedding array<float>, gid string, v int")
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i][1], dtype="f8") / np.linalg.norm(rows[i][1]) for i in good}
    pairs = [(i, j) for i in good for j in good if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    root, expected = groups_of(pairs, range(len(rows))), []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        low = min(keys, default=None)
        expected.append((key, sum(i in p for p in pairs), low, key == low))
    got = [tuple(r) for r in vectors.near_vectors(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_counterparts(spark):
    duckdb = pytest.importorskip("duckdb")
    from quire.llm import queries

    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    for name, sql in queries.ORACLES.items():
        result = queries.QUERIES[name](spark, SF_DIR)
        columns = sorted(result.columns)
        cursor = connection.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted(str(tuple(row[names.index(c)] for c in columns)) for row in cursor.fetchall())
        assert sorted(str(tuple(r[c] for c in columns)) for r in result.collect()) == want


def test_pipeline(spark):
    import corpus_pipeline

    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark)
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, SF_DIR), name.replace(" ", "-"))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == counts[3] and last.filter("not round_trip").count() == 0
