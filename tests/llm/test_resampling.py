"""Importance resampling against a count by hand."""

import hashlib
import math
import os
import random
import re
import zlib

import pytest

from factledger.llm import resampling

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, weight string, rank string, score string, n_words string"


def features(text, longest):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def by_hand(rows, target, longest=1, buckets=10_000, percent=10, least=20, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in features(text, longest)[1]:
                side[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, fit = [], []
    for i, text in rows:
        w, f = features(text, longest)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for k, r in enumerate(fit[: math.floor(percent * len(fit) / 100)], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def table():
    r = random.Random(11)
    words = ["Ab", "é1", "漢字", "a-b", "x", "Ünd", "7", "the", "of"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 5, 19, 20, 21, 60, 300])))) for i in range(300)]
    return [*rows, (None, "the " * 30), (900, None), (901, ""), (902, "?!\n"), rows[7], rows[7], (903, "the " * 4000)]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 97), (2, 10_000)])
def test_by_hand(spark, table, longest, buckets):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in table], SCHEMA).repartition(4)
    target = ["the x x of", None, "", "漢字 Ab é1 the"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, goal, longest=longest, buckets=buckets, percent=40)
    assert rows_of(got) == by_hand(table, target, longest, buckets, 40)
    assert resampling.resample(df.limit(0), goal).count() == 0
    assert rows_of(resampling.resample(df, goal.limit(0))) == by_hand(table, [])


def test_runs_do_not_cross_documents_or_chunks(monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 12))).encode() for _ in range(40)]
    for chunk, memory in ((1 << 20, 1 << 20), (1, 1), (3, 2), (7, 1)):
        monkeypatch.setattr(resampling, "CHUNK", chunk)
        monkeypatch.setattr(resampling, "MEMORY", memory)
        got = [[] for _ in texts]
        for _, doc, bucket in resampling.Features(4, 1 << 30).of(texts):
            for d, b in zip(doc.tolist(), bucket.tolist()):
                got[d].append(b)
        want = [sorted(zlib.crc32(f.encode()) % (1 << 30) for f in features(t.decode(), 4)[1]) for t in texts]
        assert [sorted(g) for g in got] == want


def test_ties_and_many_ranges(spark):
    """Rows that tie wholly get numbers of their own, over several ranges."""
    n = 5000
    w = spark.range(n).selectExpr("cast(if(id % 3 = 0, 7, id) as long) doc_id", "20L n_words", "20L n_features", "0L weight").repartition(7)
    got = resampling.draw(w, percent=50)
    ranks = [r["rank"] for r in got.orderBy(resampling.F.col("rank").asc_nulls_last()).collect()]
    assert ranks[: n // 2] == list(range(1, n // 2 + 1)) and set(ranks[n // 2 :]) == {None}
    order = [(-r["score"], r["doc_id"]) for r in got.where("rank IS NOT NULL").orderBy("rank").collect()]
    assert order == sorted(order)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query(spark):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resampling.op13(spark, SF).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    want = sorted(((r[0], *r[2:]) for r in by_hand(rows, target)), key=str)
    assert got == want and any(r[4] for r in want)
