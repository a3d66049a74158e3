"""Packing by vector bin packing with the dot-product heuristic.

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens. It takes, one after another, the
example that fits and whose demand has the largest dot product with the room that is left (both in parts of the
limits). Examples wait in a pool of fixed size, so a task's memory does not grow with its input, and a partition is
packed where it lies: nothing is shuffled. A sequence's id is its task's partition number and its number there.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

POOL = 1024
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Items are (tokens, loss tokens, payload). place() gets (payload, first token, number of tokens, sequence, offset)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, first_id: int, place):
        self.limits, self.cut, self.next_id, self.place = np.array(limits, float), cut, first_id, place
        self.items: list[list] = []  # [first, tokens, loss, payload]

    def add(self, tokens: int, loss: int, payload, first: int = 0) -> None:
        self.items.append([first, tokens, loss, payload])
        if len(self.items) >= POOL:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        """Fills sequences from the pool; before the end of the input, what can't fill one any more waits for more."""
        need = np.array([(i[1], 1, i[2]) for i in self.items], float).reshape(len(self.items), 3)
        alive = np.ones(len(self.items), bool)
        while alive.any() and (last or need[alive, 0].sum() >= self.limits[0]):
            if not last and not self.cut and alive.sum() <= POOL // 4:
                break
            room, offset = self.limits.copy(), 0
            while True:
                fits = alive & (need <= room).all(axis=1)
                if fits.any():
                    at = np.flatnonzero(fits)
                    pick = at[np.argmax((need[at] / self.limits) @ (room / self.limits))]
                    take = int(need[pick, 0])
                elif self.cut and alive.any() and room[0] >= 1 and room[1] >= 1 and room[2] >= 1:
                    at = np.flatnonzero(alive)  # no example fits: the longest gives a piece
                    pick = at[np.argmax(need[at, 0])]
                    take = int(min(room[0], room[2], need[pick, 0]))
                else:
                    break
                item, whole = self.items[pick], take == int(need[pick, 0])
                self.place(item[3], item[0], take, self.next_id, offset)
                offset += take
                used = np.array((take, 1, need[pick, 2] if whole else min(take, need[pick, 2])))
                room -= used
                if whole:
                    alive[pick] = False
                else:
                    item[0] += take
                    need[pick] -= (take, 0, used[2])
            if offset == 0:
                raise ValueError("an example is above the limits of a sequence")
            self.next_id += 1
        self.items = [[i[0], int(n[0]), int(n[2]), i[3]] for i, n, a in zip(self.items, need, alive) if a]


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: tuple[int, int, int] = (1024, 64, 1024)) -> DataFrame:
    """Whole examples into sequences: id, tokens, loss_tokens, sequence_id, offset; limits are (tokens, segments, loss tokens).

    A null count is 0; an example of 0 tokens is placed too. One above the limits by itself gets sequence_id null (there
    is no way to place it whole) and is kept in the result. Rows that repeat an id are examples of their own. An empty
    table gives an empty result.
    """
    rows = df.selectExpr(f"cast(`{id_col}` as string) id", f"cast(coalesce(`{tokens_col}`, 0) as long) tokens", f"cast(coalesce(`{loss_col}`, 0) as long) loss_tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        packer = Packer(limits, False, TaskContext.get().partitionId() << 32, lambda p, first, n, seq, off: out.append((*p, seq, off)))
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                if r[1] > limits[0] or r[2] > limits[2]:
                    out.append((*r, None, None))
                else:
                    packer.add(r[1], r[2], r)
            yield frame(out)
            out.clear()
        packer.pack(last=True)
        yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["id", "tokens", "loss_tokens", "sequence_id", "offset"]).astype({"sequence_id": "Int64", "offset": "Int64"})

    return rows.mapInPandas(run, "id string, tokens long, loss_tokens long, sequence_id long, offset long")


def encoder(path: str):
    """text -> ids of the byte-level BPE whose JSON file lies at path. The ranks beside it (.tiktoken) hold the same
    vocabulary and give the same ids several times faster; without that file the JSON one is used."""
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        end = "<|endoftext|>"
        e = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={end: len(table)})
        return lambda text: e.encode(text, allowed_special="all") if end in text else e.encode_ordinary(text)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 1024, segments: int | None = None, end_id: int = 0) -> DataFrame:
    """Documents into sequences of at most `tokens` tokens, cut freely: one row per piece (see PIECE_SCHEMA).

    A document is the ids of its whole text and then end_id; a null or empty text is end_id alone. Stretches of `tokens`
    ids are sequences of their own, the rest is packed; every token bears loss. Only the last sequence of a task is
    padded, unless a limit on segments is given and binds. Null ids stay null, rows that repeat an id are documents of their own.
    """
    rows = df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        out: list[tuple] = []

        def place(doc, first, n, seq, offset):
            doc_id, ids, base, total = doc
            out.append((doc_id, base + first, n, zlib.crc32(ids[first : first + n].tobytes()), total, seq, offset))

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=names)
            out.clear()
            return b

        packer = Packer((tokens, tokens if segments is None else segments, tokens), True, TaskContext.get().partitionId() << 32, place)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                total, full = len(ids), len(ids) // tokens * tokens
                for at in range(0, full, tokens):
                    place((doc_id, ids, 0, total), at, tokens, packer.next_id, 0)
                    packer.next_id += 1
                if full < total:
                    packer.add(total - full, total - full, (doc_id, ids[full:].copy(), full, total))
                if len(out) >= 50_000:
                    yield flush()
        packer.pack(last=True)
        yield flush()

    return rows.mapInArrow(run, PIECE_SCHEMA)


def op4(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path)
