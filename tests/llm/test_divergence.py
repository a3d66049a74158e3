"""The divergence audit against a count by hand over small tables, and against its SQL."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from factledger.llm import divergence

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, bucket string"


def by_hand(rows, least=10, top=10):
    docs, n, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for t in found:
            n[lang, source, t] += 1
        for t in set(found):
            docs[lang, t] += 1
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), k in docs.items() if x == lang and k >= least)
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        everything = sum(total.values())
        p = {(s, t): 1 + 10**9 * (n[lang, s, t] + 2) // (total[s] + 2 * len(kept)) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(n[lang, s, t] for s in sources) + 2) // (everything + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(f(p[s, t], p[o, t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s, t], q[t]), t) for t in kept if n[lang, s, t] and p[s, t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(order, 1) if part == "pair" or k <= top]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.fixture(scope="module")
def table():
    r = random.Random(3)
    words = ["der", "Die", "das", "ÄPFEL", "x1y", "zu", "über", "漢字", "a", "b-c", "DER"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    out = []
    for i in range(400):
        k = min(len(words), 1 + int(r.paretovariate(1)))
        text = " ".join(r.choice(words[: max(3, len(words) // r.randint(1, 4))]) for _ in range(k * 3))
        out.append((i if i % 7 else None, r.choice([text] * 9 + [None, "", "123 !"]), r.choice(["de", "en", None]), r.choice(["s1", "s1", "s2", None, "é"]), "clash", "clash", "clash"))
    out += [out[5]] * 12 + [(1, "only here", "rare", "s1", "", "", ""), (2, None, "rare", "s2", "", "", ""), (3, "alone", "xx", "s1", "", "", "")]
    return out


def test_by_hand(spark, table):
    df = spark.createDataFrame(table, SCHEMA).repartition(4)
    got = divergence.divergence(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = by_hand([r[1:4] for r in table])
    assert rows_of(got) == want
    assert ("rare", "s1", "pair", "s2", 0, 1) in want and any(r[2] == "term" and r[5] == 10 for r in want)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_many_small_groups_and_flushes(spark, table, monkeypatch):
    """Several buckets to a language, a task that hands its counts on often, and texts that are split."""
    monkeypatch.setattr(divergence, "GROUP", 5)
    monkeypatch.setattr(divergence, "HELD", 3)
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    assert rows_of(divergence.divergence(df, least_docs=3, top=4)) == by_hand([r[1:4] for r in table], 3, 4)


def test_long_texts_are_split_between_terms(monkeypatch):
    text = "Ab cd éé1ff  g".encode() * 50
    whole = [t for part in divergence.split_terms(text) for t in part]
    monkeypatch.setattr(divergence, "STEP", 3)
    assert [t for part in divergence.split_terms(text) for t in part] == whole
    assert list(divergence.split_terms(b"")) == []


def test_joint_cells_against_dense_counts():
    r = np.random.default_rng(1)
    counts = r.poisson(r.choice([0.2, 1, 30], 150)[None, :], (4, 150))
    counts[3] = 0
    counts[0, counts.sum(0) == 0] = 1
    total, terms = counts.sum(1), 200
    rows = defaultdict(int)
    for s, t in zip(*np.nonzero(counts)):
        rows[t // 64, s, counts[s, t]] |= 1 << (t % 64)
    word, source, n = (np.array(c, np.int64) for c in zip(*rows))
    got = divergence.joint_values(word, source, n, np.array(list(rows.values()), np.uint64), total, terms)
    p = 1 + 10**9 * (counts + 2) // (total[:, None] + 2 * terms)
    want = ((p[:, None] - p[None]) ** 2 // (p[:, None] + p[None])).sum(2)
    assert (got == want).all()
    assert (divergence._share(np.array([10**12]), np.array([10**13]), 5) == 1 + 10**9 * (10**12 + 2) // (10**13 + 10)).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(divergence.ORACLE)
    names = [c[0] for c in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in ("lang", "source", "part", "item", "value", "rank")) for r in cur.fetchall())
    assert rows_of(divergence.op12(spark, SF)) == want and want
