"""Near-duplicate detection by min-max hashing.

A document is the set of its distinct word shingles. Under each permutation both the least and the greatest image are
kept, so P permutations give 2P signature values. Bands of values make buckets; the buckets' members form clusters that
no pair of similar documents straddles (but for the banding's chance of a miss, below 1e-8 with the parameters here).
Inside a cluster, pairs are tried in the order of their estimated similarity and confirmed on the full sets; a pair that
is joined already is skipped. A large cluster is dealt out in pairs of chunks, so no task holds more than two chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm.components import components
from factledger.llm.shared import documents, materialise

ROWS, BANDS = 6, 64  # at similarity 0.8: (1 - 0.8^6)^64 = 4e-9 of pairs share no bucket
CHUNK_DOCS, CHUNK_SHINGLES = 512, 2_000_000
SKETCH = 256  # values that order and prune the pairs of a cluster
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """text -> sorted 64-bit hashes of its distinct shingles of `width` words (of the whole sequence, if it has fewer words)."""

    def __init__(self, width: int):
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > 300_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, np.uint64(min(self.width, len(h))), np.uint64)
        for i in range(min(self.width, len(h))):
            out = _mixed(out * _A + h[i : i + n] * _B)
        return np.unique(out)


class MinMax:
    """Both ends of a set's images under each of `n` permutations of the 32-bit numbers."""

    def __init__(self, n: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, n, dtype=np.uint32) * 2 + 1)[:, None]
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        high = np.zeros(len(self.a), np.uint32)
        for i in range(0, len(x), 1024):
            image = self.a * x[i : i + 1024]
            image += self.b
            np.minimum(low, image.min(1), out=low)
            np.maximum(high, image.max(1), out=high)
        return np.concatenate((low, high))


def _bands(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    s = signature[: rows * bands].reshape(bands, rows).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        h = _mixed(h * _A + s[:, i])
    return h.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (128 bits of the set; null for an empty one) and bands (array<long>, empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # Arrow: ids stay whole beside nulls
        shingles, minmax = Shingler(width), MinMax(-(-rows * bands // 2))
        for batch in batches:
            n, prints, found = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n.append(len(s))
                if len(s):
                    prints.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist())
                    found.append(_bands(minmax(s), rows, bands))
                else:
                    prints.append((None, None))
            ends = np.concatenate(([0], np.cumsum(np.array(n, np.int64) > 0))) * bands
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))
            f1, f2 = zip(*prints) if prints else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists], names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def joins(left: list[int], right: list[int], sets: list[np.ndarray], sketches: np.ndarray, threshold: float, within: bool) -> list[tuple[int, int]]:
    """A forest of confirmed links over the pairs left x right (within: the pairs of left)."""
    per_cent, parent = round(threshold * 100), list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for s in sets])
    equal = np.zeros((len(left), len(right)), np.uint16)
    for k in range(sketches.shape[1]):
        equal += sketches[left, k][:, None] == sketches[right, k][None, :]
    estimate = equal / sketches.shape[1]
    # a pair at the threshold has an estimate this far below it with a chance of 1e-9
    edge = threshold - 6 * math.sqrt(threshold * (1 - threshold) / sketches.shape[1])
    a, b = size[left][:, None], size[right][None, :]
    try_it = (estimate >= edge) & (100 * np.minimum(a, b) >= per_cent * np.maximum(a, b))
    if within:
        try_it &= np.triu(np.ones_like(try_it), 1)
    at = np.flatnonzero(try_it.ravel())
    at = at[np.argsort(-estimate.ravel()[at], kind="stable")]
    found = []
    for x, y in zip((at // len(right)).tolist(), (at % len(right)).tolist()):
        x, y = left[x], right[y]
        p, q = root(x), root(y)
        if p != q:
            both = _overlap(sets[x], sets[y])
            if 100 * both >= per_cent * (len(sets[x]) + len(sets[y]) - both):
                parent[p] = q
                found.append((x, y))
    return found


def confirmed_links(texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """texts(cluster, chunks, doc_id, f1, f2, text) -> links (u, v) that hold on the full sets and join, within each cluster, all that is
    similar, directly or through others. texts of other sets than (f1, f2), and repeated rows, are passed over."""
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    rows = texts.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    rows = rows.select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "doc_id", "f1", "f2", "text")
    rows = rows.repartition(F.col("cluster"), F.col("i"), F.col("j")).sortWithinPartitions("cluster", "i", "j", "doc_id", "f1", "f2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, minmax = Shingler(width), MinMax(SKETCH // 2, seed=17)
        key, ids, chunks, sets, last = None, [], [], [], None

        def closed() -> list[tuple[int, int]]:
            if len(ids) < 2:
                return []
            left = [n for n, c in enumerate(chunks) if c == key[1]]
            right = left if key[1] == key[2] else [n for n, c in enumerate(chunks) if c == key[2]]
            if not left or not right:
                return []
            sketches = np.stack([minmax(s) for s in sets])
            return [(ids[x], ids[y]) for x, y in joins(left, right, sets, sketches, threshold, key[1] == key[2]) if ids[x] != ids[y]]

        for pdf in batches:
            out = []
            for cluster, i, j, c, doc, f1, f2, text in pdf.itertuples(index=False, name=None):
                if (cluster, i, j) != key:
                    out += closed()
                    key, ids, chunks, sets, last = (cluster, i, j), [], [], [], None
                s = shingles(text)
                if (doc, f1, f2) != last and xxhash.xxh3_128_digest(s.tobytes()) == np.array([f1, f2], "<i8").tobytes():
                    last = (doc, f1, f2)
                    ids.append(doc)
                    chunks.append(c)
                    sets.append(s)
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(closed(), columns=["u", "v"], dtype="int64")

    return rows.mapInPandas(run, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their shingle sets is at least the threshold (in whole per cent);
    component_id is the smallest id reachable over links, kept says whether that is the row's own. Words are cut at ASCII
    white space and A-Z lower-cased; with fewer than `width` words the whole sequence is one shingle. A null or empty
    text has an empty set and is linked with nothing. Rows with a null id take no part (component_id null, kept true).
    Rows that repeat an id are compared as rows of their own. Other columns are ignored; an empty table stays empty.
    """
    sig = materialise(signatures(df, id_col, text_col, width, rows, bands), "minmax")
    # equal sets: one representative each, so thousands of copies count once from here on
    classes = materialise(sig.where("f1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "classes")
    reps = sig.select("f1", "f2", "bands", F.col("doc_id").alias("rep")).join(classes.drop("n"), ["f1", "f2", "rep"], "left_semi")
    member = reps.select("rep", F.explode("bands").alias("bucket"))
    lead = member.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last")
    lead = materialise(lead.select("bucket", "first"), "buckets")
    clusters = materialise(components(member.join(lead, "bucket").select(F.col("rep").alias("u"), F.col("first").alias("v"))), "clusters")
    listed = clusters.join(classes, clusters["node"] == classes["rep"]).select(F.col("root").alias("cluster"), "rep", "f1", "f2", "n")
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK_DOCS, F.sum("n") / CHUNK_SHINGLES)).cast("int")
    sized = listed.groupBy("cluster").agg(chunks.alias("chunks"))
    listed = materialise(listed.drop("n").join(sized, "cluster"), "listed")
    # dealt by id at every size: the list of members grows with the input, so it isn't broadcast even where it is small
    texts = df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").join(listed.hint("merge"), F.col("doc_id") == F.col("rep")).drop("rep")
    links = materialise(confirmed_links(texts, width, threshold), "links")
    found = components(links)
    named = classes.join(found, classes["rep"] == found["node"], "left").select("f1", "f2", F.coalesce("root", "rep").alias("component"))
    named = materialise(named, "named")
    out = sig.drop("bands").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of df of which near_duplicates says kept, with all their columns: one document of each component. Rows that
    share an id stay together, if any of them is kept."""
    kept = near_duplicates(df, id_col, text_col, width, threshold).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return df.join(kept, df[id_col].cast("long").eqNullSafe(kept["_kept"]), "left_semi")
