"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector; learned filters run over overlapping chunks that cover the whole document; each filter
is max-pooled within a chunk; the pooled chunks are combined by their mean and their maximum, and a logistic layer gives
one probability. Training is on the driver from a bounded sample, scoring runs where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm.shared import documents, least, residue

CHUNK, STEP, WIDTH, DEPTH, FILTERS = 512, 448, 6, 4, 24
#: Bound of the training sample: labelled documents, each with its whole text.
MAX_DOCS, EPOCHS, SEED = 2400, 10, 11
SCHEMA = "doc_id long, score double"


def chunks(data: bytes) -> np.ndarray:
    """The whole text as rows of CHUNK bytes that overlap by CHUNK - STEP; the last is filled with zeros."""
    n = max(1, -(-max(0, len(data) - (CHUNK - STEP)) // STEP))
    buffer = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    buffer[: len(data)] = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(sliding_window_view(buffer, CHUNK)[::STEP])


@dataclass
class ByteNet:
    embed: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int, share: float) -> ByteNet:
        rng = np.random.default_rng(seed)
        f = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        start = np.log(share / (1 - share))
        return cls(f(256, DEPTH, s=0.5), f(WIDTH * DEPTH, FILTERS, s=0.25), np.zeros(FILTERS, np.float32), f(2 * FILTERS, s=0.05), np.array([start], np.float32))

    def windows(self, block: np.ndarray) -> np.ndarray:
        x = self.embed[block]  # chunks x CHUNK x DEPTH
        view = sliding_window_view(x.reshape(len(block), -1), WIDTH * DEPTH, axis=1)[:, ::DEPTH]
        return np.ascontiguousarray(view)  # chunks x places x WIDTH * DEPTH

    def pooled(self, block: np.ndarray) -> np.ndarray:
        """Max of each filter over each chunk (through a ReLU)."""
        y = (self.windows(block).reshape(-1, WIDTH * DEPTH) @ self.filters).reshape(len(block), -1, FILTERS)
        return np.maximum(y.max(1) + self.bias, 0)

    def traced(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pooled(), and of each filter where its maximum was and what it saw there; a few chunks at a time, so that the windows of a
        long text are never held at once."""
        parts = []
        for i in range(0, len(block), 256):
            w = self.windows(block[i : i + 256])
            y = (w.reshape(-1, WIDTH * DEPTH) @ self.filters).reshape(len(w), -1, FILTERS)
            at = y.argmax(1)
            top = np.take_along_axis(y, at[:, None], 1)[:, 0] + self.bias
            parts.append((np.maximum(top, 0), at, w[np.arange(len(w))[:, None], at]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def score(self, data: bytes) -> float:
        rows, total, top = chunks(data), np.zeros(FILTERS), np.zeros(FILTERS)
        for i in range(0, len(rows), 64):  # bounded memory for a text of any length
            h = self.pooled(rows[i : i + 64])
            total += h.sum(0)
            top = np.maximum(top, h.max(0))
        z = np.concatenate((total / len(rows), top)) @ self.out + self.out_bias[0]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> ByteNet:
    """Adam on the log-loss, 64 documents a step. With one class or no rows the net gives that class's smoothed share."""
    share = float((labels.sum() + 1) / (len(labels) + 2))
    net, rng = ByteNet.fresh(seed, share), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    docs = [chunks(t) for t in texts]
    names = ("embed", "filters", "bias", "out", "out_bias")
    m, v, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(docs)), 0.02 * (1 - epoch / epochs) + 0.002
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            block, owner = np.concatenate([docs[j] for j in pick]), np.repeat(np.arange(len(pick)), [len(docs[j]) for j in pick])
            h, at, seen = net.traced(block)  # seen: chunks x FILTERS x WIDTH * DEPTH
            n = np.bincount(owner, minlength=len(pick)).astype(np.float32)
            starts = np.concatenate(([0], np.cumsum(n[:-1]).astype(int)))
            mean, top = np.add.reduceat(h, starts) / n[:, None], np.maximum.reduceat(h, starts)
            feats = np.concatenate((mean, top), 1)
            p = 1 / (1 + np.exp(-(feats @ net.out + net.out_bias[0])))
            g = ((p - labels[pick]) / len(pick)).astype(np.float32)
            grad = {"out": feats.T @ g + 1e-4 * net.out, "out_bias": g.sum(keepdims=True)}
            back = g[:, None] * net.out  # to the features of each document
            is_top = (h == top[owner]) / np.maximum(np.add.reduceat((h == top[owner]).astype(np.float32), starts), 1)[owner]
            dh = (back[:, :FILTERS] / n[:, None])[owner] + back[owner, FILTERS:] * is_top
            dh *= h > 0
            grad["bias"] = dh.sum(0)
            grad["filters"] = np.einsum("cf,cfk->kf", dh, seen)
            back_x = (dh[:, :, None] * net.filters.T).reshape(-1, DEPTH)
            letters = block[np.arange(len(block))[:, None, None], at[:, :, None] + np.arange(WIDTH)].reshape(-1)
            grad["embed"] = np.stack([np.bincount(letters, back_x[:, d], 256) for d in range(DEPTH)], 1)
            step += 1
            for name in names:
                x, gr = getattr(net, name), np.asarray(grad[name], np.float32)
                m[name] = 0.9 * m[name] + 0.1 * gr
                v[name] = 0.99 * v[name] + 0.01 * gr * gr
                x -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", max_docs: int = MAX_DOCS) -> ByteNet:
    """Learns from the whole texts of at most max_docs labelled rows that `usable` (on doc_id) holds for: those with the least hashes
    of id and label. A null or unknown label or a null id is not learned from; a document with labels both ways counts once for
    each, and of rows of docs that repeat an id the one with the least text counts."""
    known = labels.where(usable & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("y")).distinct()
    chosen = least(known.withColumn("h", F.xxhash64(F.lit("quality"), "doc_id", "y")), "h", max_docs, known.count()).select("doc_id", "y")
    # max_docs rows of two numbers are broadcast, and as many texts come back
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values(["doc_id", "y", "text"], kind="stable")
    return fit([t.encode("utf-8", "replace") for t in rows["text"]], rows["y"].to_numpy(np.float32))


def score(df: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for every row, from its whole text alone; a null text counts as empty. Null and repeated ids
    pass through, other columns are ignored, an empty table gives an empty result."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # Arrow: ids stay whole beside nulls
        for batch in batches:
            got = [shared.value.score((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), residue("doc_id", 5) != 0)
    return score(docs, net).select("doc_id", (residue("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
