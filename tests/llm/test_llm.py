"""The operators on small tables with nulls, empty and very long texts, ties, repeated rows, clashing names and no rows at all,
each against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factledger.llm import chat, exact_dedup, langid, lm, minhash, mixing, packing, quality, sharding, topk
from factledger.llm.components import components
from factledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, kept int, bucket string, rep int"
TEXTS = [None, "", "  \n", "one", "One", "a b c d e f", "A b c d  e f", "a b c d e g", "été ÉTÉ straße", "x " * 60_000, "\x00 weird   text", "<|endoftext|> tail", "a b c d e f"]


def rows(texts):
    return [(i if i != 3 else None, t, ["en", "fr", None][i % 3], ["s", None, "é"][i % 3], None, "clash", "clash", 7, "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    r = rows(TEXTS)
    return spark.createDataFrame([*r, r[-1]], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().lower().split()


# exact dedup

def test_exact_groups(docs, none):
    got = [r.asDict() for r in exact_dedup.exact_groups(docs).collect()]
    groups = defaultdict(list)
    for i, t, *_ in docs.collect():
        t = t or ""
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((i, len(t)))
    want = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] if m[0] is not None else math.inf))[0]
        want += [{"doc_id": i, "keep_id": keep, "group_size": len(members), "kept": i == keep, "text_sha256": hashlib.sha256(norm.encode()).hexdigest()} for i, _ in members]
    key = lambda r: (r["text_sha256"], str(r["doc_id"]))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert exact_dedup.exact_groups(none).count() == 0
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups) and exact_dedup.drop_copies(none).count() == 0


# near-duplicates

def brute_components(pairs_of, width):
    sets = {}
    for i, t in pairs_of:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label, sets


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, none, width):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((8, 40, 90)))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(6)):
                t[rng.randrange(len(t))] = f"v{rng.randrange(999)}"
            texts.append(" ".join(t))
    many = [(i + 100, t) for i, t in enumerate(texts)]
    given = docs.select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(i, t, 0) for i, t in many], "doc_id long, text string, kept int"))
    got = minhash.near_duplicates(given, width=width).collect()
    label, sets = brute_components([(r["doc_id"], r["text"]) for r in given.collect() if r["doc_id"] is not None], width)
    assert len(got) == given.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_chunked_cluster_finds_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_DOCS", 4)
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join([*base[: 60 - i], *(f"x{i}-{k}" for k in range(i))])) for i in range(25)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    label, _ = brute_components(texts, 2)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, width=2).collect()} == label


def test_both_ends_are_kept_and_estimate_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    mm = minhash.MinMax(400)
    x, y = (mm(minhash._mixed(v)) for v in (a, b))
    assert len(x) == 800 and abs((x == y).mean() - 800 / 1200) < 0.07
    assert (x[:400] <= x[400:]).all()


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 13] + [(5, 5), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(chain).collect()}
    assert got == {n: max(s for s in (1, 14, 27) if s <= n) for n in range(1, 40)}
    assert components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[(5, 2), (2, 5), (9, 2)], [(2, 5), (2, 9), (5, 9)], [(3, 1), (3, 2), (7, 2), (8, 6)], "random"])
def test_components_against_plain_python(spark, edges):
    if edges == "random":
        rng = np.random.default_rng(3)
        edges = [(int(u), int(v)) for u, v in rng.integers(0, 300, (220, 2))]
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(rows) == len(label) and {r["node"]: r["root"] for r in rows} == label


# mixing

def test_mix(docs, none, spark):
    more = spark.createDataFrame([(1000 + i, "w " * (i % 17), None, f"z{i % 4}") for i in range(300)], "doc_id long, text string, lang string, source string")
    df = docs.select("doc_id", "text", "lang", "source", "size").unionByName(more, allowMissingColumns=True)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    size, goal, taken = Counter(), {}, Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["taken"] <= 2 * r["size"] and r["taken"] == r["times"] * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_ = 1.5 * sum(size.values()), set(names)
    want = {}
    while open_:  # clamp, share out the excess, until nothing is above its clamp
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * size[s] + 1e-9}
        if not over:
            want |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            want[s] = 2.0 * size[s]
        left -= sum(want[s] for s in over)
        open_ -= over
    for s in names:
        assert abs(goal[s] - want[s]) < 1e-6 * max(1, want[s])
        biggest = max(r["size"] for r in got if r["source"] == s)
        assert abs(taken[s] - goal[s]) <= max(biggest, 1)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert mixing.repeat_rows(df).count() == sum(r["times"] for r in got)
    assert mixing.mix(none).count() == 0 and mixing.repeat_rows(none).columns == none.columns


# packing

def ids_by_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_round_trip(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack_documents(docs, path).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for doc_id, text in texts:
        ids = np.array(ids_by_tokenizers(text), "<u4")
        mine = sorted(by_doc[doc_id], key=lambda p: (p["start"], p["sequence_id"]))
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in mine)
        copies = sum(d == doc_id for d, _ in texts)
        assert sorted(i for p in mine for i in range(p["start"], p["start"] + p["length"])) == sorted([*range(len(ids))] * copies)
    fill = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and len(seq) <= 256
        fill += at
    assert fill / (1024 * len(by_seq)) > 0.9
    assert packing.pack_documents(none, path).count() == 0


def test_whole_examples_under_three_limits(spark):
    rng = random.Random(1)
    ex = [(str(i), rng.randrange(0, 900), rng.randrange(0, 300)) for i in range(3000)] + [("big", 5000, 1), ("null", None, None)]
    df = spark.createDataFrame(ex, "k string, t long, l long")
    got = packing.pack_examples(df, "k", "t", "l", (1024, 5, 400)).collect()
    assert Counter(r["id"] for r in got) == Counter(k for k, *_ in ex)
    bins = defaultdict(list)
    for r in got:
        if r["sequence_id"] is None:
            assert r["id"] == "big"
        else:
            bins[r["sequence_id"]].append(r)
    for b in bins.values():
        assert sum(r["tokens"] for r in b) <= 1024 and len(b) <= 5 and sum(r["loss_tokens"] for r in b) <= 400
    assert sum(r["tokens"] for b in bins.values() for r in b) / (1024 * len(bins)) > 0.8


# language-model scoring

def test_lm_base_and_order(docs, none, spark):
    usable = F.col("doc_id") % 4 != 0
    model = lm.train(docs, usable)
    got = lm.score(docs, usable, model).collect()
    tok = lambda t: [*words(t), b"\n"]
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    c = Counter(x for i, t in given if i is not None and i % 4 for x in tok(t))
    n, v = sum(c.values()), len(c)
    want = {(i, len(tok(t)), sum(c[x] > 0 for x in tok(t))): sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok(t)) for i, t in given}
    assert len(got) == len(given)
    for r in got:
        assert r["train_tokens"] == n and r["score"] < 0
        assert abs(r["base_score"] - want[r["doc_id"], r["n_tokens"], r["n_known"]]) < 1e-6 * max(1, abs(r["base_score"]))
    assert lm.score(none, usable, lm.train(none, usable)).count() == 0


def _model(rng):
    """A model that knows every pair that begins with one of a few bytes, with counts of all 256 bytes in each context."""
    asked = lm.Asked()
    for a in (b"", b"a", b"ab", *(b"ab" + bytes([x]) for x in range(256))):
        for x in range(256):
            asked.add(a + bytes([x]), True, 1)
    asked._count()
    k, n = asked.pairs.all()
    return lm.ByteModel(lm._odds(k, rng.integers(1, 9, len(k))), rng.normal(0.3, 0.1, (lm.PREDICTORS, 3, 8)).astype(np.float32), rng.normal(0, 3, 8 * lm.CELLS).astype(np.float32), k)


def test_lm_is_a_distribution():
    m = _model(np.random.default_rng(0))
    # after "ab", the 256 bytes share what is left
    total = sum(10 ** _costs(m, b"ab" + bytes([x]))[2] for x in range(256))
    assert abs(total - 1) < 1e-4


def _costs(m, data):
    """log10 of the probability of each byte, before any update."""
    words, now, last = m.odds([bytes(lm.GAP) + data + b"\0"])
    x, gate, sign = words.view(np.int8).reshape(-1, lm.PREDICTORS, 8).transpose(1, 0, 2).astype(float), lm._CLASS[last], lm._SIGNS[now]
    z = sum(x[k] * m.weights[k][gate] for k in range(lm.PREDICTORS))
    cell = (np.clip(z * sign, -127, 127) / 8 + (lm.CELLS // 2 + 0.5)).astype(np.intp) + lm._CELL_OF_BIT
    z = np.clip(z + m.refine[cell] * sign, -160, 160)
    return -np.log1p(np.exp(-z / 16)).sum(1) / math.log(10)


# top-k

def test_topk(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, rng.integers(-3, 4, 8).tolist()) for i in range(400)]
    bad = [(1000, None), (1050, []), (None, [1] * 8)]
    df = spark.createDataFrame(vecs + bad, "vec_id long, v array<long>")
    got = defaultdict(list)
    for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, x in vecs[::50]:
        best = sorted(((i, int(np.dot(x, y))) for i, y in vecs if i != q), key=lambda p: (-p[1], p[0]))[:5]
        assert sorted(got[q]) == [(k + 1, *b) for k, b in enumerate(best)]
    assert len(got) == 8 and topk.exact_topk(df.limit(0), F.lit(True)).count() == 0
    q = spark.createDataFrame([(1, [0.5, None]), (2, [float("nan")]), (3, [0.999, -0.001]), (4, None)], "vec_id long, e array<float>").select("vec_id", topk.quantised("e", 256.0).alias("v")).collect()
    assert [r["v"] for r in q] == [None, None, [255, -1], None]


# chat

def test_chat_fold_and_read_back(spark):
    ev = [
        (1, 0, 0, "message", "user", "hi <|im_end|> \\n \\<|"), (1, 1, 1, "delta", None, "par"), (1, 1, 2, "delta", None, "tial"), (1, 2, 3, "message", "user", "void"),
        (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "new"), (1, 1, 6, "edit", None, "final \\"), (1, 2, 7, "message", "user", None), (1, 3, 8, "message", "assistant", "end"), (None, 0, 0, "message", None, None),
    ]
    df = spark.createDataFrame(ev, "conv_id long, message long, seq long, kind string, role string, text string").repartition(4)
    parts = chat.format_chats(df)
    want = [("user", ev[0][5]), ("assistant", "final \\"), ("user", ""), ("assistant", "end")]
    text = "".join(r["rendered"] for r in sorted(parts.where("conv_id = 1").collect(), key=lambda r: r["message"]))
    assert [(chat.unescape(m[1]), chat.unescape(m[2])) for m in chat._TURN.finditer(text)] == want
    got = {r["conv_id"]: r for r in chat.chat_digests(parts).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_sha256"] == hashlib.sha256(b"final \\end").hexdigest() and got[1]["loss_chars"] == 10
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
    assert got[1]["formatted_chars"] == len(text) and got[None]["n_turns"] == 1
    assert chat.chat_digests(chat.format_chats(df.limit(0))).count() == 0


# sharding

def test_sharding(docs, none):
    names = sharding.shard_names(16)
    table = sharding.lookup_table(names, 4099)
    share = np.bincount(table)
    assert len(share) == 16 and share.max() - share.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 4099)
    stay = table < 15
    assert (table[stay] == fewer[stay]).mean() > 0.8
    # brute force: each shard's preference list, claimed in turns
    prefs = [[(sharding._number(s, "offset") + k * (sharding._number(s, "step") % 4098 + 1)) % 4099 for k in range(4099)] for s in names]
    want, at, i = {}, [0] * 16, 0
    while len(want) < 4099:
        while prefs[i][at[i]] in want:
            at[i] += 1
        want[prefs[i][at[i]]] = i
        i = (i + 1) % 16
    assert [want[k] for k in range(4099)] == table.tolist()
    got = sharding.place(docs, "doc_id", names, 4099).collect()
    assert len(got) == docs.count()
    for r in got:
        slot = int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest()[:15], 16) % 4099
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.place(none, "doc_id", names).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 4100)


@tables
def test_the_slot_of_every_document_in_sql(spark):
    import duckdb

    got = sorted((r["doc_id"], r["slot"]) for r in QUERIES["op9_shard_placement"](spark, SF).select("doc_id", "slot").collect())
    sql = f"SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.PRIME} FROM '{SF}/documents.parquet' ORDER BY 1"
    assert got == duckdb.sql(sql).fetchall()


# ids beside nulls, names that clash, folders, samples

BIG = 2**53 + 1


def test_ids_stay_whole_beside_nulls(spark):
    words_ = [f"w{i}" for i in range(40)]
    rows_ = [(None, " ".join(words_[:20])), (BIG, " ".join(words_)), (BIG + 1, " ".join(words_)), (BIG + 2, " ".join(words_[:39]) + " z")]
    df = spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1)
    ids = {BIG, BIG + 1, BIG + 2, None}
    of = lambda out: {r["doc_id"] for r in out.collect()}
    lang = langid.train(df.withColumn("lang", F.lit("en")), F.lit(True))
    assert of(langid.identify(df, lang)) == ids
    net = quality.fit([b"a", b"b"], np.array([0.0, 1.0], np.float32), epochs=1)
    assert of(quality.score(df, net)) == ids
    assert of(minhash.near_duplicates(df, width=2)) == ids and of(exact_dedup.exact_groups(df)) == ids
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, width=2).collect()} == {None: None, BIG: BIG, BIG + 1: BIG, BIG + 2: BIG}
    usable = F.lit(True)
    assert of(lm.score(df, usable, lm.train(df, usable))) == ids
    import public_tokenizers

    assert of(packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"))) == ids
    assert of(mixing.plan(df.withColumn("source", F.lit("s")))) == ids
    ev = df.select(F.col("doc_id").alias("conv_id"), F.lit(BIG).alias("message"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("kind"), F.lit("user").alias("role"), "text")
    parts = chat.format_chats(ev)
    assert {r["conv_id"] for r in parts.collect()} == ids and {r["message"] for r in parts.collect()} == {BIG} and {r["conv_id"] for r in chat.chat_digests(parts).collect()} == ids


def test_exact_dedup_keeps_one_row_at_the_ends_of_the_id_range(spark):
    ends = (-(2**63), -1, 0, 2**63 - 1)
    df = spark.createDataFrame([(i, "same") for i in ends] + [(2**63 - 1, "longer one"), (None, "longer one")], "doc_id long, text string")
    got = {(r["doc_id"], r["group_size"]): (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()}
    assert all(got[i, 4] == (ends[0], i == ends[0]) for i in ends) and got[ends[3], 2] == (ends[3], True) and got[None, 2] == (ends[3], False)
    assert exact_dedup.drop_copies(df).count() == 2


def test_the_mix_leaves_columns_of_any_name_alone(spark):
    names = ["size", "target", "taken", "times", "whole", "source_size", "_s", "_cutoff", "s", "key", "row", "copy"]
    df = spark.createDataFrame([(i, "w " * (i % 9), f"z{i % 3}", *[f"{n}{i}" for n in names]) for i in range(60)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.repeat_rows(df)
    assert out.columns == df.columns
    seen = Counter(r["doc_id"] for r in out.collect())
    assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
    plan = {r["doc_id"]: r["times"] for r in mixing.plan(df).collect()}
    assert seen == Counter({i: t for i, t in plan.items() if t})
    assert {r["doc_id"]: r["times"] for r in mixing.mix(df).collect()} == plan and mixing.mix(df).columns == ["doc_id", "text", "source", "_s", "_cutoff", "s", "key", "row", "copy", *mixing.FACTS]


def test_an_unknown_kind_of_event_stops_the_job(spark):
    ev = spark.createDataFrame([(1, 0, 0, "redact", "user", "x")], "conv_id long, message long, seq long, kind string, role string, text string")
    with pytest.raises(Exception, match="unknown kind of event: redact"):
        chat.format_chats(ev).collect()


def test_the_least_hashes_are_drawn_at_every_size(spark):
    from factledger.llm.shared import least

    rows_ = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    want = sorted(r["h"] for r in rows_.collect())[:7]
    assert sorted(r["h"] for r in least(rows_, "h", 7, 20_000).collect()) == want
    same = spark.range(3000).selectExpr("5L h", "id % 2 x")
    assert least(same, "h", 7, 3000).count() == 7  # rows that tie are no reason to take more
    assert least(rows_, "h", 30_000, 20_000).count() == 20_000 and least(rows_, "h", 0, 20_000).count() == 0 and least(rows_.limit(0), "h", 5, 0).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from factledger.llm.shared import shared_dir

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master)))


# models on the test tables

def test_decoding_in_plain_python():
    rng = np.random.default_rng(3)
    for n in (2, 4, 7):
        code = langid.codewords(n)
        model = langid.LanguageModel([f"l{i}" for i in range(n)], code, rng.normal(0, 2, (2, langid.BUCKETS, code.shape[1])).astype(np.float32), 1.7)
        for text in ("Hello, World", "é", "abc " * 50, "a1b2"):
            b = [32, *(x if x >= 128 or chr(x).isalpha() else 32 for x in text.lower().encode()), 32]
            pairs = [b[i] << 8 | b[i + 1] for i in range(len(b) - 1)]
            triples = [((((b[i] << 8 | b[i + 1]) << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16) & 0xFFFF for i in range(len(b) - 2)]
            z = [(sum(float(model.weights[0, p, k]) for p in pairs) + sum(float(model.weights[1, t, k]) for t in triples)) / (len(pairs) + len(triples)) for k in range(code.shape[1])]
            loss = [sum(math.log1p(math.exp(-c * 1.7 * x)) for c, x in zip(word, z)) for word in code.tolist()]
            chance = [math.exp(min(loss) - x) for x in loss]
            chance = [c / sum(chance) for c in chance]
            lang, score, unsure = model.predict(text)
            best = max(range(n), key=lambda i: chance[i])
            assert lang == f"l{best}" and abs(score - chance[best]) < 1e-5 and unsure == (sorted(chance)[-2] > 0.8 * chance[best])


def test_the_network_forward_by_loops():
    net = quality.ByteNet.fresh(3, 0.3)
    net.bias = np.random.default_rng(1).normal(0, 0.3, quality.FILTERS).astype(np.float32)
    for data in (b"", b"abc", bytes(range(256)) * 4):
        pooled, at = [], 0
        while True:
            chunk = list(data[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0"))
            tops = []
            for f in range(quality.FILTERS):
                best = max(sum(float(net.embed[chunk[i + w], d]) * float(net.filters[w * quality.DEPTH + d, f]) for w in range(quality.WIDTH) for d in range(quality.DEPTH)) for i in range(0, quality.CHUNK - quality.WIDTH + 1))
                tops.append(max(0.0, best + float(net.bias[f])))
            pooled.append(tops)
            if at + quality.CHUNK >= len(data):
                break
            at += quality.STEP
        feats = [sum(c) / len(pooled) for c in zip(*pooled)] + [max(c) for c in zip(*pooled)]
        z = sum(x * float(w) for x, w in zip(feats, net.out)) + float(net.out_bias[0])
        assert abs(net.score(data) - 1 / (1 + math.exp(-z))) < 1e-5
        break_even = net.traced(quality.chunks(data))[0]
        assert np.allclose(break_even, pooled, atol=1e-5)


def test_codewords():
    for n in (1, 2, 3, 4, 5, 9):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
        if n > 1:
            assert min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a)) >= (1 if n == 2 else 2)


def test_models_on_edge_cases(docs, none):
    model = langid.train(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[0]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, langid.train(none, F.lit(True))).count() == 0
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("quality"))
    net = quality.train(docs, labels, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, net).collect())
    assert quality.score(none, quality.train(none, labels.limit(0), F.lit(True))).count() == 0
    assert sum(len(c) for c in [quality.chunks(b"x" * 5000)]) * quality.STEP + 64 >= 5000


@tables
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op2_language_id"](spark, SF).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97
    q = QUERIES["op8_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", "quality").toPandas()
    rank = q["score"].rank().to_numpy()
    pos = q["quality"].to_numpy() == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.9


@tables
def test_pipeline_against_plain_python(spark):
    import corpus_pipeline

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = df.collect()
    kept = corpus_pipeline.exact(spark, df, "").select("doc_id").toPandas()["doc_id"].tolist()
    best = {}
    for r in docs:
        k = "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r")
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(r["text"] or ""), r["doc_id"]))
    assert sorted(kept) == sorted(i for _, i in best.values())
    near = corpus_pipeline.near(spark, df, "").select("doc_id").toPandas()["doc_id"].tolist()
    label, _ = brute_components([(r["doc_id"], r["text"]) for r in docs], 5)
    assert sorted(near) == sorted({*label.values()})
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, df, "").columns == df.columns


@tables
def test_language_mix_and_pack_stages_against_plain_python(spark):
    import corpus_pipeline

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(df, F.lit(True))
    kept = {}
    for r in df.collect():
        lang, _, unsure = model.predict(r["text"])
        if lang != "und" and not unsure:
            kept[r["doc_id"]] = r.asDict() | {"lang": r["lang"] if r["lang"] is not None else lang}
    assert {r["doc_id"]: r.asDict() for r in corpus_pipeline.language(spark, df, "").collect()} == kept
    plan = {r["doc_id"]: r["times"] for r in mixing.plan(df).collect()}
    mixed = corpus_pipeline.mixed(spark, df, "").collect()
    rows_ = {r["doc_id"]: r for r in df.collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({i: t for i, t in plan.items() if t}) and all(r == rows_[r["doc_id"]] for r in mixed)
    some = df.where("doc_id < 60")
    pieces = corpus_pipeline.packed(spark, some, "").collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for r in some.collect():
        ids = np.array(ids_by_tokenizers(r["text"]), "<u4")
        mine = sorted(by_doc[r["doc_id"]], key=lambda p: p["start"])
        assert [p["start"] for p in mine] == [0, *np.cumsum([p["length"] for p in mine])[:-1]] and sum(p["length"] for p in mine) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in mine)
    for seq in by_seq.values():
        seq.sort()
        assert [o for o, _ in seq] == [0, *np.cumsum([n for _, n in seq])[:-1]] and sum(n for _, n in seq) <= 1024


@tables
def test_ids_of_the_whole_corpus_agree_with_tokenizers(spark):
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert list(encode(text)) == e.ids


@tables
def test_near_duplicates_of_the_corpus_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    n = [f"t{i}" for i in range(12)]  # 10 shingles of two words, of which 8 of 10 or 7 of 10 are shared
    more = [(-1, " ".join(n[:10])), (-2, " ".join(n[:9])), (-11, " ".join([*n[:9], "q"])), (-21, " ".join(n[:7]))]
    df = df.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    label, _ = brute_components([(r["doc_id"], r["text"]) for r in df.collect()], 2)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, width=2).collect()} == label
    edge = [(1, "a b c d e f"), (2, "a b c d e"), (3, "a b c d")]  # 4 of 5 shingles are 0.8 exactly, 3 of 4 are less
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(edge, "doc_id long, text string"), width=2).collect()} == {1: 1, 2: 1, 3: 3}
    total = corpus_total(spark)
    assert total[0] > 0 and total[1] > 50


def corpus_total(spark):
    import corpus_pipeline

    return corpus_pipeline.run(spark, "/root/testdata/sf0.001").agg(F.sum("length"), F.count_distinct("doc_id")).first()


# names that clash, corpora without labels, very short texts

CLASH = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_score string, lang_ambiguous string, _guess string, _slot string, row string, guess string, slot string, shard string"


@pytest.fixture(scope="module")
def clash(spark):
    said = {"en": "the cat and the dog went over the hill with them", "de": "der Hund und die Katze gingen mit ihnen auf den Berg"}
    r = [(i, f"{said[k]} {i} {said[k]}" if i % 9 else [None, "", "123"][i % 3], k if i % 4 else None, f"s{i % 2}", i, *["x"] * 9) for i, k in enumerate(["en", "de"] * 30)]
    return spark.createDataFrame(r, CLASH)


def test_stages_keep_every_column(spark, clash):
    import corpus_pipeline

    before = {r["doc_id"]: r for r in clash.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, None)
        assert out.columns == clash.columns, name
        rest = [c for c in clash.columns if c != "lang"]
        assert all([r[c] for c in rest] == [before[r["doc_id"]][c] for c in rest] for r in out.collect()) and out.count()
    got = corpus_pipeline.language(spark, clash, None)
    assert {r["doc_id"]: r["lang"] for r in got.collect()} == {i: ["en", "de"][i % 2] for i in range(60) if i % 9}
    placed = sharding.place(clash, "doc_id", sharding.shard_names(4))
    assert sorted(placed.columns) == sorted(clash.columns) and placed.where("_slot = 'x' AND row = 'x' AND shard LIKE 'shard-%'").count() == 60
    named = langid.label_rows(clash, langid.train(clash, F.lit(True)))
    assert sorted(named.columns) == sorted(clash.columns) and named.where("_guess = 'x' AND guess = 'x' AND lang_pred <> 'x'").count() == 60


def test_a_corpus_without_labels_is_kept(spark, clash):
    import corpus_pipeline

    bare = clash.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language(spark, bare, None)
    assert got.columns == bare.columns and sorted(r["doc_id"] for r in got.collect()) == [i for i in range(60) if i % 9]
    assert corpus_pipeline.language(spark, bare.limit(0), None).count() == 0


def test_very_short_texts_fill_their_sequences(spark):
    import public_tokenizers

    df = spark.range(5000).selectExpr("id doc_id", "if(id % 2 = 0, '', null) text").coalesce(1)
    got = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy(F.desc("n")).collect()
    assert [r["n"] for r in got] == [1024] * 4 + [5000 - 4096]


def test_repeated_ids_are_learned_from_once(spark):
    docs_ = spark.createDataFrame([(1, "good text " * 30)] * 500 + [(2, "bad !!!! " * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = quality.train(docs_.distinct(), labels, F.lit(True))
    assert all(np.array_equal(getattr(once, n), getattr(quality.train(docs_, labels, F.lit(True)), n)) for n in ("filters", "out", "embed"))


def test_blocks_list_only_ranges_that_they_ask_for():
    own = lm.Asked()
    own.add(lm.folded("a few words that are asked for"), True, 1)
    for bits in (0, 3, 20):
        rows_ = [r for part in own.slices(7, bits) for r in part.to_pylist()]
        assert len({r["slice"] for r in rows_}) == len(rows_) <= min(1 << bits, 200) and all(any(r[c] for c in ("pairs", "tokens", "borders")) for r in rows_)
        keys_ = np.concatenate([lm._unpack(r["pairs"], "<u8") for r in rows_])
        assert np.array_equal(keys_, own.pairs.all()[0])
