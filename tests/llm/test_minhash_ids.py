"""Two texts under one id: both take part, whichever is met first."""

import random

import pytest

from factledger.llm import minhash


def test_two_texts_under_one_id(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, b + " more"), (8, a + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = minhash.near_duplicates(df, width=2).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False)]


@pytest.mark.parametrize("chunk", [512, 7])
def test_buckets_of_many_families(spark, monkeypatch, chunk):
    """Buckets of one value each hold documents of many families that aren't similar."""
    monkeypatch.setattr(minhash, "CHUNK_DOCS", chunk)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    texts = []
    for family in range(15):
        base = [*common, *(f"f{family}-{i}" for i in range(20))]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"v{rng.randrange(999)}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, width=2, rows=1, bands=64).collect()}
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label)) and len(set(label)) > 10
