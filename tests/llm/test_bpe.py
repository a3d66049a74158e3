"""The byte-pair codec against the library that reads the same rank file, and exact round trips."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from factledger.llm import bpe
from factledger.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "  \n\n x", "one", "don't we'll I'VE", "été ÉTÉ straße 漢字 🙂🙂", "a" * 5000, " a" * 3000, "\x00\x1c\x85　x", "<|endoftext|> tail", "12345 67  89", "!?!?... --", "one", "\U0010ffff́"]


@pytest.fixture(scope="module")
def codec():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_perfect_hash_has_no_gaps():
    for n in (1, 2, 7, 1000):
        keys = [f"key {i}".encode() for i in range(n)]
        h = bpe.PerfectHash(keys)
        assert sorted(h.key_at) == list(range(n)) and list(h.candidates(keys)) == list(range(n))
    assert len(bpe.PerfectHash([]).candidates([b"x"])) == 1


def test_every_word_is_found_whole(codec):
    """Also words that merging alone would not reach."""
    assert (codec.hash.candidates(codec.words) == np.arange(len(codec.words))).all()


def test_merge_takes_the_least_rank_then_the_leftmost(codec):
    codec._prepare()

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(codec.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in codec.rank]
            if not found:
                return [codec.rank[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(5)
    for k in range(1500):
        piece = bytes(r.choice(b"abcderst \xc3\xa9\x00\xff") for _ in range(r.randint(1, 1 + k % 40)))
        assert codec.merge(piece) == slow(piece)


def test_same_ids_as_the_library(codec, library, monkeypatch):
    r = random.Random(7)
    texts = TEXTS + ["".join(r.choice("aAé漢 \n\t'sд1!🙂́") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    want = [np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for t in texts]
    for step, memory in ((1 << 20, 500_000), (50, 20), (1, 1)):
        monkeypatch.setattr(bpe, "STEP", step)
        monkeypatch.setattr(bpe, "MEMORY", memory)
        got = list(codec.encode(texts))
        assert got == want
        assert [codec.decode(g) for g in got] == [(t or "").encode() for t in texts]


def test_unknown_ids_are_refused(codec):
    with pytest.raises(ValueError):
        codec.decode(np.array([60_000], "<u4").tobytes())
    assert codec.decode(b"") == b""


def test_tables(spark, codec, library):
    rows = [(i if i != 3 else None, t, "clash", "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, decoded string, n_tokens string").repartition(3)
    got = bpe.encode_documents(df, codec)
    back = bpe.decode_documents(got.withColumnRenamed("doc_id", "decoded").withColumn("ids2", got["ids"]), codec, "ids2")
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted((t or "").encode() for t in [*TEXTS, TEXTS[-1]])
    want = sorted((-1 if i is None else i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, *_ in [*rows, rows[-1]])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in got.collect()) == want
    assert bpe.encode_documents(df.limit(0), codec).count() == 0
    assert bpe.decode_documents(got.selectExpr("cast(null as binary) ids").limit(1), codec).first()["decoded"] is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for i, t in docs:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want
