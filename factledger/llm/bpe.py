"""Byte-level BPE: ids of texts, and texts of ids.

A pre-token that is a word of the vocabulary is found whole: a minimal perfect hash gives every word a slot of its own in a table
without gaps, and one comparison of bytes tells whether the pre-token is that word. The others are merged: their bytes are linked, a
heap holds the neighbours that a merge joins, the least rank first, then the leftmost; each merge relinks its neighbours.
"""

from __future__ import annotations

import base64
import gc
import heapq
import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm.shared import documents

#: Characters that a worker splits at once, and pre-tokens whose ids it remembers from one step to the next.
STEP, MEMORY = 1 << 20, 800_000
_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Every key has a slot of its own among as many slots as there are keys. Keys fall into small buckets by one half of a 128-bit hash;
    from the largest bucket on, each takes the first shift that sends the other halves of its keys to slots that are free."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n, self.buckets = len(keys), len(keys) // per_bucket + 1
        bucket, rest = self._hashes(keys)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(self.n, bool)
        self.shift = np.zeros(self.buckets, np.uint64)
        self.key_at = np.zeros(self.n, np.int64)
        for b in np.argsort(-np.diff(edges), kind="stable"):
            mine = order[edges[b] : edges[b + 1]]
            if not len(mine):
                break
            start, width = 0, 32
            while True:
                shifts = np.arange(start, start + width, dtype=np.uint64)
                slots = self._slots(rest[mine][None, :], shifts[:, None])
                ok = free[slots].all(1)
                if len(mine) > 1:
                    ok &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(1)
                if ok.any():
                    k = int(ok.argmax())
                    break
                start, width = start + width, min(2 * width, 1 << 14)
                if start > 1 << 32:
                    raise ValueError("keys repeat")
            self.shift[b], self.key_at[slots[k]] = shifts[k], mine
            free[slots[k]] = False

    def _hashes(self, keys: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
        return (h[:, 0] % np.uint64(self.buckets)).astype(np.int64), h[:, 1]

    def _slots(self, rest: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (_mix(rest + _mix(shift + np.uint64(1))) % np.uint64(self.n)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each, the number of the only key that it can be."""
        if not self.n or not keys:
            return np.zeros(len(keys), np.int64)
        bucket, rest = self._hashes(keys)
        return self.key_at[self._slots(rest, self.shift[bucket])]


class _Known(dict):
    """pre-token -> its number; one that is met for the first time gets the next number and waits in `fresh` to be encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class Codec:
    """Ids of texts by ranks(token, id); the tables are built once and sent to the workers, which keep them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words, self.ids = list(ranks), np.fromiter(ranks.values(), np.int64, len(ranks))
        self.pattern, self.hash = pattern, PerfectHash(self.words)
        self.ready = False

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("words", "ids", "pattern", "hash")} | {"ready": False}

    def _prepare(self) -> None:
        """What a worker makes for itself from the tables."""
        if self.ready:
            return
        self.split = regex.compile(self.pattern)
        self.rank = dict(zip(self.words, self.ids.tolist()))
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        top = int(self.ids.max()) + 1
        self.first, self.size = np.zeros(top, np.int64), np.full(top, -1, np.int64)
        self.first[self.ids], self.size[self.ids] = np.cumsum(size) - size, size
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)
        self._forget()
        self.ready = True

    def _forget(self) -> None:
        self.known = _Known()
        self.known_ids, self.known_end = array("I"), array("q", [0])

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. Work grows with n log n; what it holds, with its own length."""
        n, rank = len(piece), self.rank
        bits = n.bit_length()
        ids = [self.byte[b] for b in piece]
        joins = [rank.get(piece[i : i + 2], -1) for i in range(n - 1)]  # of the part that begins here with the one after it; -1: none
        joins.append(-1)
        heap = [(r << bits) | i for i, r in enumerate(joins) if r >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heapq.heappop(heap)
            r = x >> bits
            i = x ^ (r << bits)
            if joins[i] != r:
                continue  # one of its parts has gone into another merge
            gone = after[i]
            end = after[gone]
            ids[i], ids[gone], after[i], joins[gone], joins[i] = r, -1, end, -1, -1
            if end < n:
                before[end] = i
                joins[i] = r = rank.get(piece[i : after[end]], -1)
                if r >= 0:
                    heapq.heappush(heap, (r << bits) | i)
            p = before[i]
            if p >= 0:
                joins[p] = r = rank.get(piece[p:end], -1)
                if r >= 0:
                    heapq.heappush(heap, (r << bits) | p)
        return [x for x in ids if x >= 0]

    def _learn(self) -> None:
        """Puts the ids of new pre-tokens into the memory, in the order of their numbers."""
        raw = [p.encode() for p in self.known.fresh]
        self.known.fresh = []
        at = self.hash.candidates(raw)
        for b, word, i in zip(raw, map(self.words.__getitem__, at.tolist()), self.ids[at].tolist()):
            if word == b:
                self.known_ids.append(i)
            else:
                self.known_ids.extend(self.merge(b))
            self.known_end.append(len(self.known_ids))

    def encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """The ids of each part of a text, or of each text."""
        if len(self.known) > MEMORY:
            self._forget()
        pieces = [self.split.findall(p) for p in parts]
        flat = list(itertools.chain.from_iterable(pieces))
        where = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        self._learn()
        end = np.array(self.known_end, np.int64)
        ids = ragged(np.array(self.known_ids, "<u4"), end[where], end[where + 1])
        upto = np.concatenate(([0], np.cumsum(end[where + 1] - end[where])))
        edges = upto[np.cumsum([0, *map(len, pieces)])]
        return [ids[a:b] for a, b in itertools.pairwise(edges.tolist())]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers, texts of about STEP characters at a time. A longer one is split where a word
        begins, which no pre-token spans."""
        self._prepare()
        waiting: list[tuple[int, str]] = []  # (number of the text, part)
        held = done = 0

        def flush(n: int) -> Iterator[bytes]:
            found: list[list[bytes]] = [[] for _ in range(n - done)]
            for (k, _), ids in zip(waiting, self.encode_parts([p for _, p in waiting])):
                found[k - done].append(ids.tobytes())
            return map(b"".join, found)

        n = 0
        for n, text in enumerate(texts, 1):
            text, at = text or "", 0
            if waiting and held + len(text) > STEP:
                yield from flush(n - 1)
                waiting, held, done = [], 0, n - 1
            if len(text) <= STEP:
                waiting.append((n - 1, text))
                held += len(text)
                continue
            found = []
            while at < len(text):
                cut = _CUT.search(text, at + STEP) if at + STEP < len(text) else None
                to = cut.start() if cut else len(text)
                found.append(self.encode_parts([text[at:to]])[0].tobytes())
                at = to
            yield b"".join(found)
            done = n
        yield from flush(n)

    def decode(self, raw: bytes) -> bytes:
        """The bytes of ids as encode() gives them; an id that isn't in the vocabulary is an error."""
        self._prepare()
        ids = np.frombuffer(raw, "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for at in range(0, len(ids), STEP):
            part = ids[at : at + STEP]
            out.append(ragged(self.bytes, self.first[part], self.first[part] + self.size[part]).tobytes())
        return b"".join(out)


def ragged(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """values[start:end] of each range, one after another."""
    n = end - start
    at = np.repeat(start - (np.cumsum(n) - n), n)
    return values[at + np.arange(len(at))]


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file (base64 of the token, blank, id) at path, read by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def load(path: str, pattern: str | None = None) -> Codec:
    """The codec of a rank file; without a pattern, the one that belongs to the public files."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return Codec(read_ranks(path), pattern)


def encode_documents(df: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row; ids as little-endian unsigned 32-bit numbers. With `decoded` a column of that name too: the bytes
    that these ids say, by the same workers.

    Every match of the pattern is encoded by itself, without special tokens (their strings are ordinary text). A null text counts as
    empty and has no ids. Null ids stay null, rows that repeat an id or a text are rows of their own, other columns are not read. A
    worker holds a batch of rows, about STEP characters of pre-tokens and MEMORY pre-tokens with their ids. An empty table stays empty.
    """
    sent = df.sparkSession.sparkContext.broadcast(codec)  # as large as the vocabulary, whatever the input
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            gc.disable()  # nothing below makes cycles, and the many short-lived lists would set it off again and again
            ids = list(sent.value.encode(t.as_py() for t in batch.column(1)))
            gc.enable()
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decoded:
                columns.append(pa.array([sent.value.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "ids", "n_tokens", *["decoded"] * decoded]
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long" + ", decoded binary" * decoded)


def decode_documents(df: DataFrame, codec: Codec, ids_col: str = "ids") -> DataFrame:
    """df with a column `decoded` (in place of one of that name): the bytes of its ids. Null ids give null; an id that isn't in the vocabulary stops the job."""
    sent = df.sparkSession.sparkContext.broadcast(codec)
    rows = df.drop("decoded")
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else sent.value.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit(None).cast("binary")).schema)


def op11(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = encode_documents(documents(spark, sf_dir), load(ranks_path), decoded=True)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
