"""Operators on single rows and on narrow tables: op1, op3, op4, op5, op6."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import pytest
from helpers import documents, stored_documents
from pyspark.sql import functions as F

from quire.llm import mixing, pieces, quality, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(3)
PROSE = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))) for _ in range(40)]
RANDOM = base64.b64encode(hashlib.sha512(b"k").digest()).decode().rstrip("=")[:72]
LINE = "one two three four five six seven eight nine ten"
ROWS = [
    (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, f"{LINE}\n{LINE}\n\n{LINE}", "a"), (None, "x é ##|", "c"),
    (4, f"{LINE}\n{LINE}\n\n{LINE}", "a"), (5, "and " * 5000, "b"),
    *[(10 + k, t, rng.choice("abcd")) for k, t in enumerate(PROSE)],
]


def test_quality_measures(spark):
    got = quality.quality_report(documents(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    expected = []
    for key, text, _ in ROWS:
        words, seen, repeated = WORD.findall(text or ""), set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count, covered = collections.Counter(windows), set()
        for i, window in enumerate(windows):
            if count[window] > 1:
                covered.update(range(i, i + 8))
        expected.append((
            key, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words)))
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, expected))
    assert not any(r.kept for r in got if r.base_failed)


def test_rules_keep_prose_and_do_not_depend_on_their_order(spark):
    prose = "The harbour was quiet that morning, and nobody had yet come down to look at the boats or the water. " * 1
    text = prose + "Later a small crowd gathered near the old pier to watch the ferry leave for the islands again."
    df = documents(spark, [(1, text, "a"), (2, text.replace(" ", " ### "), "a"), (3, None, "a")])
    rules = quality.default_rules()
    for order in (rules, rules[::-1]):
        assert [r.doc_id for r in df.filter(quality.passes(order, F.col("text"))).collect()] == [1]
    assert quality.quality_filter(df).columns == df.columns
    assert quality.order_rules(df.limit(0), rules) == rules


def test_secret_spans(spark):
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "é Password: 'abc.def' secret=token: abcdefgh", "a"),
        (4, "AKIA" + "Q" * 16 + " AKIAX " + "0f" * 12 + "g" + "a" * 23, "a"), (5, "token = ab api_key=abcdef12", "a"),
        (6, ("api_key=" + "x" * 8 + " ") * 300, "a"), (7, f"see {RANDOM} done", "a"),
    ]
    got = {r.doc_id: r for r in secrets.secret_report(documents(spark, rows)).collect()}
    patterns = [
        ("assign", re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
         lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    for key, text, _ in rows:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns)
                       for m in p.finditer(text or "") if ok(m))
        joined = ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[key].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert joined in got[key].spans or key == 7
    assert got[7].spans == f"random:4:{4 + len(RANDOM)}"
    clean = secrets.redact(documents(spark, rows))
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] is None and texts[7] == "see [SECRET] done" and texts[6] == "[SECRET] " * 300
    assert secrets.secret_report(documents(spark, rows[:2])).filter("spans <> ''").count() == 0


def test_ordinary_tokens_pass_the_battery(spark):
    words = ["abcdefghijklmnopqrstuvwxyz0123456789", "internationalizations_of_everything", "aaaaaaaaaaaaaaaaaaaaaaaa",
             "usr/local/share/doc/packages/readme", "THISISACONSTANTNAMEINCAPITALS"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert min(r[0] for r in df.select(secrets.ordinary_p(F.col("s"))).collect()) > 0.05


def test_mixing(spark, tmp_path):
    rows = ROWS + [(100 + k, "w " * (1 + k % 37), rng.choice(["a", "b", "c", "d", None])) for k in range(400)]
    df = stored_documents(spark, tmp_path, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size, by_source = collections.Counter(), {}
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * size[s] if s in full else level * weight[s] for s in names}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and any(abs(t - r.target) < 1e-6 * t for t in target.values())
        by_source[(r.source_size, round(r.target, 3))] = by_source.get((r.source_size, round(r.target, 3)), 0) + r.taken
    for (_, wanted), taken in by_source.items():
        assert abs(taken - wanted) <= 5000  # its largest document
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_sharding(spark):
    import struct

    import math
    xxhash = pytest.importorskip("xxhash")
    got = sharding.shard_plan(documents(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    slots = collections.defaultdict(list)
    expected = collections.Counter()
    for key, text, _ in ROWS:
        raw, scores = (text or "").encode(), []
        for shard in range(41):
            seed = xxhash.xxh64_intdigest(("\0null" if key is None else str(key)).encode(), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed)
            scores.append((-math.log(((h >> 11) + 0.5) / 2**53), shard))
        expected[(key, len(raw) + 16, zlib.crc32(raw), min(scores[:40])[1], min(scores)[1])] += 1
    assert expected == collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_plan(documents(spark, ROWS[:0] or ROWS).limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("sentencepiece")
    try:
        return pieces.load_vocabulary()
    except OSError:
        pytest.skip("the model file is not here")


def test_nbest_against_all_segmentations(vocabulary):
    for _ in range(150):
        text = "".join(rng.choice("abe t\nh é") for _ in range(rng.randint(1, 11)))
        known = {0: [(0.0, ())]}
        chunk = pieces.SPACE + text.replace(" ", pieces.SPACE)
        for end, here in enumerate(pieces.edges(vocabulary, chunk)):
            if end:
                known[end] = [(s + c, i + x) for b, c, x in here for s, i in known[b]]
        best = sorted((s for s, _ in known[len(chunk)]), reverse=True)
        ranked = pieces.segment(vocabulary, text, 5)
        assert [s for s, _ in ranked] == best[:5]
        assert len({tuple(i) for _, i in ranked}) == len(ranked)
        assert all(pieces.decode(vocabulary, i) == text for _, i in ranked)
        # The digested changes lead from the best segmentation to the others.
        found, _, combined = pieces.ranked(vocabulary, text, 5)
        lines = pieces.changes_text(found, combined).split("\n") if len(combined) > 1 else []
        for line, (_, other) in zip(lines, ranked[1:], strict=True):
            changed = list(ranked[0][1])
            for change in reversed(line.split(";")):
                before, replaced, new = change.split(":")
                changed[int(before) : int(before) + int(replaced)] = map(int, new.split())
            assert changed == other


def test_memory_of_chunks(vocabulary, monkeypatch):
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma", "日本", "x")) + str(rng.randrange(40)) for _ in range(30)) for _ in range(20)]
    whole = [pieces.segment(vocabulary, t) for t in texts]
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 6)
    monkeypatch.setattr(pieces, "CACHE_SEARCHES", 2)
    vocabulary.cache.clear(), vocabulary.old.clear(), vocabulary.searches.clear()
    assert [pieces.segment(vocabulary, t) for t in texts] == whole
    assert len(vocabulary.cache) <= 3 and len(vocabulary.old) <= 3 and len(vocabulary.searches) <= 2


def test_pieces_round_trip(spark, vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [None, "", " ", "  a  b ", "▁x▁", "日本 \U0001F600", "\ttab\r\n", "<s> <0x0A>", "ab" * 20_000]
    df = documents(spark, [(k, t, "a") for k, t in enumerate(texts)])
    for r in pieces.with_pieces(df, decoded="back", alternatives="others").collect():
        assert r.back == r.text and (r.piece_ids is None) == (r.text is None)
        if r.text:
            assert model.decode(r.piece_ids) == r.text and r.others[0] == r.piece_ids
            assert list(r.nbest_scores) == sorted(r.nbest_scores, reverse=True)
    for r in pieces.piece_report(df).collect():
        ids = pieces.segment(vocabulary, texts[r.doc_id] or "", 1)[0][1]
        assert r.round_trip and r.n_pieces == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
