"""Importance resampling toward a target: hashed n-gram features, log-ratio gains, Gumbel top-k.

Batch concatenation: the texts of a batch are joined with a separator that is no part of a word, one pass of a pattern finds all words
of the batch, and a search in the documents' offsets says whose each word is; n-grams whose words belong to different documents are
masked before the buckets are counted.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factledger.llm.shared import documents, materialise

#: Production parameters: longest run of words, buckets, percent drawn, words of a document that can be drawn, seed of the noise.
RUN, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, "2024"
#: Bytes of texts that are joined, words that are looked at together, and words whose bucket a task remembers.
STEP, CHUNK, MEMORY = 1 << 22, 200_000, 300_000
_WORD, _SEPARATOR = re.compile(rb"[0-9a-z\x80-\xff]+"), b"\n"


class Features:
    """Buckets of the runs of 1 to `longest` words of documents."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets, self.known = longest, buckets, {}

    def _hashed(self, runs: list[bytes]) -> np.ndarray:
        return np.fromiter((zlib.crc32(r) % self.buckets for r in runs), np.int64, len(runs))

    def _of_words(self, words: list[bytes]) -> np.ndarray:
        fresh = set(words).difference(self.known)
        if len(self.known) + len(fresh) > MEMORY:
            self.known = {}
            fresh = set(words)
        self.known.update((w, zlib.crc32(w) % self.buckets) for w in fresh)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the texts, some CHUNK words at a time: (document of each word, document of each feature, bucket of each feature)."""
        joined = _SEPARATOR.join(texts).lower()
        ends = np.cumsum([len(t) + 1 for t in texts])
        found = _WORD.finditer(joined)
        tail: list[bytes] = []  # the last words of the chunk before, with which runs may begin
        tail_doc = np.zeros(0, np.int64)
        while matches := list(itertools.islice(found, CHUNK)):
            new = [m.group() for m in matches]
            new_doc = np.searchsorted(ends, np.fromiter((m.start() for m in matches), np.int64, len(matches)), "right")
            docs, buckets = [new_doc], [self._of_words(new)]
            words, doc = tail + new, np.concatenate((tail_doc, new_doc))
            for n in range(2, self.longest + 1):
                last = np.arange(max(len(tail), n - 1), len(words))
                last = last[doc[last] == doc[last - n + 1]]  # a run lies in one document
                docs.append(doc[last])
                buckets.append(self._hashed([b" ".join(words[i - n + 1 : i + 1]) for i in last.tolist()]))
            yield new_doc, np.concatenate(docs), np.concatenate(buckets)
            keep = max(0, len(words) - self.longest + 1)
            tail, tail_doc = words[keep:], doc[keep:]


def _joined(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of about STEP bytes."""
    at, held, size = 0, [], 0
    for text in texts:
        text = text.as_py() or b""
        if held and size + len(text) > STEP:
            yield at, held
            at, held, size = at + len(held), [], 0
        held.append(text)
        size += len(text)
    yield at, held


def bucket_counts(df: DataFrame, text_col: str = "text", longest: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends a row for each bucket at most. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = Features(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _joined(batch.column(0)):
                for _, _, found in made.of(texts):
                    total += np.bincount(found, minlength=buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(total[have], pa.int64())], names=["bucket", "n"])

    counts = df.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from (bucket, n) of the corpus and of the target: a thousand times the log of the ratio of its smoothed
    shares, rounded down. `buckets` numbers of each side come to the driver, however large they are."""
    sides = []
    for counts in (own, target):
        side = [0] * buckets
        for bucket, n in counts.select("bucket", "n").toLocalIterator():
            side[bucket] = n
        sides.append(side)
    s, t = sides
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t)], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the sum of its features' gains, 0 for a text without words."""
    buckets = len(gain)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(longest, buckets)
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for at, texts in _joined(batch.column(1)):
                k = len(texts)
                here = out[:, at : at + k]
                for word_doc, doc, bucket in made.of(texts):
                    here[0] += np.bincount(word_doc, minlength=k)
                    here[1] += np.bincount(doc, minlength=k)
                    here[2] += np.bincount(doc, weights=gain[bucket], minlength=k).astype(np.int64)  # whole numbers far below 2^53
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str | Column, seed: str = SEED) -> Column:
    """A thousandfold Gumbel variable, rounded down, from the hash of seed and id; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """weights(doc_id, n_words, n_features, weight) with score and rank: of the N rows with enough words, floor(percent * N / 100) are drawn,
    highest scores first, ties to the smaller id (a null id first; rows that tie wholly in any order). Others have a null rank.

    Rows are dealt by ranges of the order and numbered inside their range; a range then starts where those before it end, so no task sees
    more than its range, and the one sum over all of them has a row for each range.
    """
    w = materialise(weights.withColumn("score", (F.col("weight") + noise("doc_id", seed)).cast("long")), "resampling-weights")
    fit = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    # rows of one id and score are told apart by their place in the written table, so they need not share a range
    can = w.where(fit).withColumn("_place", F.monotonically_increasing_id())
    can = can.repartitionByRange(*order, F.asc("_place")).sortWithinPartitions(*order, F.asc("_place")).withColumn("_at", F.monotonically_increasing_id())
    can = materialise(can.select(*w.columns, F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_in")), "resampling-order")
    sizes = can.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select("_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_start") + F.col("_in") + 1
    drawn = F.when(rank <= F.floor(F.col("_all") * percent / 100), rank)
    ranked = can.join(starts, "_range").select(*w.columns, drawn.cast("long").alias("rank"))
    return ranked.unionByName(w.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of df, drawn toward the texts of target.

    Words are runs of digits, ASCII letters (lower-cased) and of all that isn't ASCII; a feature is a run of 1 to `longest` of them, joined by
    one blank. Null and empty texts have no feature and weight 0. Rows that repeat an id are rows of their own, other columns are not
    read. An empty target leaves gains that favour rare buckets; an empty df gives an empty result.
    """
    gain = gains(bucket_counts(df, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets)
    return draw(weigh(df, gain, id_col, text_col, longest), percent, least_words, seed)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
