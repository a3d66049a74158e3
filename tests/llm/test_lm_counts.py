"""op5: its parts against plain Python, and the query's score against a fold of the text in plain loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factledger.llm import lm

WHITE = b" \t\n\x0b\x0c\r"


def test_tokens_are_the_words_and_the_end(monkeypatch):
    rng = random.Random(1)
    some = [b" ", b"\n", b"\t", b"a", b"bc", b"\x00", b"\xc3\xa9", b"d", b"  ", b"efg"]
    texts = [b"".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(400)] + [b"", b" ", b"x", b"y" * 100]

    def told():
        t, where, counts = lm.tokens(texts)
        seen, i = {}, 0
        for data, n in zip(texts, counts):
            words = data.split()
            assert n == len(words) + 1 and t[i + n - 1] == lm._END and where[i + n - 1] == len(data)
            for j, w in enumerate(words):
                assert data[where[i + j] :].startswith(w) and seen.setdefault(w, int(t[i + j])) == int(t[i + j])
            i += n
        assert len(set(seen.values())) == len(seen)
        return seen

    whole = told()
    monkeypatch.setattr(lm, "SPAN", 16)  # long texts are cut, but words are not
    assert told() == whole


def plain_recalled(data: bytes) -> list[list[int]]:
    """The log-odds of the predictor that learns within a piece."""
    d = bytes(lm.GAP) + data + b"\0"
    seen, out = defaultdict(list), []
    for i in range(lm.GAP, len(d)):
        context, now = d[i - lm.RECALL : i], d[i]
        past, bits = seen[context], [0] * 8
        if past:
            times = 1 + (len(past) > 1 and past[-2] == past[-1]) + (len(past) > 2 and past[-3] == past[-2] == past[-1])
            sure = {1: 24, 2: 38, 3: 52}[times]
            for b in range(8):
                same = (past[-1] >> (7 - b)) & 1 == (now >> (7 - b)) & 1
                bits[b] = sure if same else -sure
                if not same:
                    break
        out.append(bits)
        past.append(now)
    return out


def test_the_recall_learns_from_the_first_bytes():
    rng = random.Random(4)
    texts = [b"", b"aaaaaaaaaaaa", b"abcdefg abcdefg abcdefh abcdefg", bytes(rng.choice(b"ab") for _ in range(500))]
    buffer, piece, real = lm._joined([p for t in texts for p in lm.pieces(t)])
    k = lm.keys(buffer)[lm.ORDERS.index(lm.RECALL)][real]
    got = lm.recalled(k, buffer[lm.GAP :][real], piece[real]).view(np.int8).reshape(-1, 8).tolist()
    assert got == [x for t in texts for x in plain_recalled(t)]


def context_counts(texts):
    """Counts of each (order, context, byte)."""
    c = Counter()
    for t in texts:
        d = bytes(lm.GAP) + t + b"\0"
        c.update((k, d[i - k : i], d[i]) for i in range(lm.GAP, len(d)) for k in lm.ORDERS)
    by_line = Counter()
    for (order, context, byte), n in c.items():
        for s in range(9):
            by_line[order, context, s, byte >> s] += n
    return by_line


def line_odds(by_line, order, context, byte):
    out = []
    for bit in range(8):
        mine, above = by_line[order, context, 7 - bit, byte >> (7 - bit)], by_line[order, context, 8 - bit, byte >> (8 - bit)]
        out.append(int(np.clip(np.rint(16 * np.log(np.float32((mine + 0.3) / (above - mine + 0.3)))), -127, 127)))
    return out


def plain_borders(data):
    """(hash of the words before, text that follows, its begin and end) of every border of a text, by the rule in words."""
    words, begins, i = [], [], 0
    for w in data.split():
        i = data.index(w, i)
        words.append(int(lm.tokens([w])[0][0]))
        begins.append(i)
        i += len(w)
    top, mul, mix = (1 << 64) - 1, int(lm._MUL), int(lm._MIX)
    at = []
    for j in range(lm.WINDOW - 1, len(words) - 1):
        x = (words[j] * mul + words[j - 1]) & top
        x = ((x ^ (x >> 29)) * mix) & top
        if x >> 60 == 0:
            at.append(j)
    out = []
    for n, j in enumerate(at):
        begin, end = begins[j + 1], begins[at[n + 1] + 1] if n + 1 < len(at) else len(data) + 1
        out.append((tuple(words[j - lm.WINDOW + 1 : j + 1]), data[begin : min(end, len(data))], begin, end))
    return out


def plain_score(data, rank, by_line, follows, weights, refine):
    """log10 of the model's probability of a text, bit by bit. follows: words before a border -> the (rank, what follows) of training texts."""
    nats, known, run = 0.0, set(), 0
    ones, zeros = [lm.GUESS * p for p in lm.GOES_ON], [lm.GUESS * (1 - p) for p in lm.GOES_ON]
    for words, text, begin, end in plain_borders(data):
        mine = (xxhash.xxh32_intdigest(text, end > len(data)))
        theirs = sorted(follows.get(words, []))
        other = None
        if theirs:
            other = theirs[0] if theirs[0][0] != rank else theirs[-1]
        if other is None or other[0] == rank:
            run = 0
            continue
        hit, s = other[1] == mine, min(run, 3)
        nats -= math.log((ones if hit else zeros)[s] / (ones[s] + zeros[s]))
        (ones if hit else zeros)[s] += 1
        run = run + 1 if hit else 0
        if hit:
            known |= set(range(begin, end))
    w, r = weights.astype(float).copy(), refine.astype(float).copy()
    d, recall = bytes(lm.GAP) + data + b"\0", plain_recalled(data)
    todo = [i for i in range(len(data) + 1) if i not in known]
    for begin in range(0, len(todo), lm.STEP):
        dw, dr = np.zeros_like(w), np.zeros_like(r)
        for i in todo[begin : begin + lm.STEP]:
            j = i + lm.GAP
            gate, byte = lm._CLASS[d[j - 1]], d[j]
            x = [*(line_odds(by_line, k, d[j - k : j], byte) for k in lm.ORDERS), recall[i]]
            for bit in range(8):
                sign = 1 if (byte >> (7 - bit)) & 1 else -1
                z = sum(x[p][bit] * w[p, gate, bit] for p in range(lm.PREDICTORS))
                cell = int(min(127, max(-127, z * sign)) / 8 + lm.CELLS // 2 + 0.5) + bit * lm.CELLS
                z = min(160, max(-160, z + r[cell] * sign))
                e = math.exp(-z / 16)
                nats += math.log1p(e)
                miss = e / (1 + e)
                for p in range(lm.PREDICTORS):
                    dw[p, gate, bit] += x[p][bit] * miss
                dr[cell] += miss * sign
        w += lm.RATE / 16 / lm.STEP * dw
        r += lm.PUSH * dr
    return -nats / math.log(10)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.randrange(1, 160)) for _ in range(60)]
    long = text(400)
    texts += [long, long, long + " " + text(40), text(30) + "\n" + long[:1500], "", " ", None, "É " + text(20)]
    rows = [*enumerate(texts), (None, texts[3]), (61, long), (2**53 + 1, texts[5])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("block", [1 << 24, 1 << 13])
def test_the_score_is_that_of_a_fold_in_plain_python(corpus, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "SLICE_BYTES", block)
    usable = F.col("doc_id") % 5 != 0
    model = lm.train(corpus, usable, tuning_docs=3)
    got = lm.score(corpus, usable, model).collect()
    rank = (F.shiftrightunsigned(F.xxhash64(F.lit("lm"), "doc_id", "text"), 33) + 1).alias("rank")
    given = [(r["doc_id"], lm.folded(r["text"]), r["rank"]) for r in corpus.select("doc_id", "text", rank).collect()]
    learned = [(t, k) for i, t, k in given if i is not None and i % 5]
    by_line, follows = context_counts([t for t, _ in learned]), defaultdict(list)
    for t, k in learned:
        for words, text, _, end in plain_borders(t):
            follows[words].append((k, xxhash.xxh32_intdigest(text, end > len(t))))
    assert len(got) == len(given)
    want = defaultdict(list)
    for i, t, k in given:
        if len(t) < 700 or i in (60, 61):
            want[i].append(plain_score(t, k, by_line, follows, model.weights, model.refine))
    checked = 0
    for r in got:
        if r["doc_id"] in want and (r["n_bytes"] < 700 or r["doc_id"] in (60, 61)):
            assert min(abs(r["score"] - x) for x in want[r["doc_id"]]) < 1e-3 * max(1, abs(r["score"]))
            assert abs(r["bits_per_byte"] + r["score"] * math.log2(10) / (r["n_bytes"] + 1)) < 1e-9
            checked += 1
    assert checked > 40
    twice = [r["bits_per_byte"] for r in got if r["doc_id"] == 61]
    assert max(twice) < 0.5 * np.median([r["bits_per_byte"] for r in got if r["n_bytes"] > 300])


def test_counts_are_the_same_however_the_input_is_split(corpus):
    usable = F.col("doc_id") % 5 != 0
    a, b = (sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in lm.score(d, usable, lm.train(d, usable)).collect()) for d in (corpus, corpus.coalesce(1)))
    assert a == b


def test_tuning_counts_leave_out_the_tuning_documents():
    k, none = np.array([0x100, 0x101, 0x200], np.uint64), np.zeros(0, np.uint64)
    told = lambda block, n: (block, 0, lm._pack(k), lm._pack(np.array(n, "<u4")), *[lm._pack(none)] * 6)
    import pyarrow as pa

    types = [pa.int64(), pa.int32(), *[pa.binary()] * 8]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(told(0, [9, 4, 3]), told(lm.TUNING_BLOCK, [5, 4, 0])), types)], names=lm._names(lm.ASKED))
    rows = next(lm._answers(iter([batch]))).to_pylist()
    odds = {r["block"]: lm._table([(r["pairs"], r["odds"])])[1].view(np.int8).reshape(-1, 8)[:, 7].tolist() for r in rows if r["block"] != lm.TOTALS}
    ratio = lambda a, b: round(16 * math.log((a + 0.3) / (b + 0.3)))
    assert odds == {0: [ratio(9, 4), ratio(4, 9), ratio(3, 0)], lm.TUNING_BLOCK: [ratio(4, 0), ratio(0, 4), ratio(3, 0)]}


def test_texts_side_by_side_cost_what_they_cost_alone(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 101, n, dtype=np.uint8)) for n in (0, 1, 63, 64, 65, 1000, 3000)] * 2
    asked = lm.Asked()
    for t in texts:
        asked.add(t, True, 1)
    asked._count()
    k, n = asked.pairs.all()
    m = lm.ByteModel(lm._odds(k, n.astype(np.int64)), rng.normal(0.4, 0.1, (lm.PREDICTORS, 3, 8)).astype(np.float32), np.zeros(8 * lm.CELLS, np.float32), k)
    alone = [m.log10(t) for t in texts]
    assert np.allclose(m.log10s(texts), alone, rtol=1e-5)
    hidden = [None, None, *[np.arange(len(t) + 1) % 7 < 3 for t in texts[2:]]]
    assert np.allclose(m.log10s(texts, hidden), [m.log10s([t], [h])[0] for t, h in zip(texts, hidden)], rtol=1e-5)
    monkeypatch.setattr(lm, "NEAR", 100)
    assert np.allclose(m.log10s(texts), alone, rtol=1e-5)


def test_no_part_of_the_training_documents_is_singled_out(corpus):
    """Weights and refinement are fixed before any text is read, so only counts of all training documents tell corpora apart."""
    models = [lm.train(d, F.col("doc_id") % 5 != 0) for d in (corpus, corpus.where("doc_id > 20"))]
    for m in models:
        assert (m.weights == np.float32(lm.START)).all() and not m.refine.any()
        assert m.answers.where(F.col("block") == lm.TUNING_BLOCK).count() == 0
