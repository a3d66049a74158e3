"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Queries and candidates are packed into blocks. For a pair of blocks, each dimension is a term: its postings are the
candidates' components, and every query that has the term scatters weight * posting into its dense score array. The
best k of each array are found by partition selection; what the blocks found is merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192


def quantised(vec_col: str, scale: float) -> Column:
    """floor(scale * x) of each component as long; null where the vector or a component is null or not finite."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """One row per block: (block, ids, width, data); rows(vec_id, v) are dealt by a hash of the id and their own order."""
    n_blocks = max(1, -(-n // size))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(len(v) for v in pdf["v"])
        m = np.zeros((len(pdf), width), dtype="<i8")
        for i, v in enumerate(pdf["v"]):
            m[i, : len(v)] = v
        return pd.DataFrame([(int(pdf["block"].iloc[0]), pdf["vec_id"].to_numpy("<i8").tobytes(), width, m.tobytes())], columns=["block", "ids", "width", "data"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(packed, "block int, ids binary, width int, data binary")


def _best(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            qid, cid = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.ids, "<i8")
            q = np.frombuffer(r.q_data, "<i8").reshape(len(qid), r.q_width)
            postings = np.ascontiguousarray(np.frombuffer(r.data, "<i8").reshape(len(cid), r.width).T)
            out: list[tuple[np.ndarray, ...]] = []
            for i in range(len(qid)):
                score = np.zeros(len(cid), dtype=np.int64)
                for term in np.flatnonzero(q[i, : r.width]):
                    score += q[i, term] * postings[term]
                mine = np.flatnonzero(cid != qid[i])
                s = score[mine]
                if len(mine) > k:  # all that reach the k-th score, so that ties are settled by id
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    mine = mine[s >= edge]
                ranked = mine[np.lexsort((cid[mine], -score[mine]))][:k]
                out.append((np.full(len(ranked), qid[i]), cid[ranked], score[ranked]))
            if out:
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))


def exact_topk(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """rows(vec_id long, v array<long>) -> query_id, rank, vec_id, score: for every row that is_query holds for, the k rows with
    the highest inner product, ties to the smaller id. Rows with a null id or vector take no part; a row is no candidate
    of queries with its own id; rows that repeat an id are candidates each, but rank as one query. Where lengths differ the
    shorter vector is filled with zeros. Arithmetic is 64-bit. Empty tables give an empty result."""
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").select("vec_id", "v")
    queries = rows.where(is_query).dropDuplicates(["vec_id"])
    n_rows, n_queries = rows.count(), queries.count()
    q = _blocks(queries, QUERY_BLOCK, n_queries).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data"))
    c = _blocks(rows, CANDIDATE_BLOCK, n_rows)
    # a stated query set against all rows, block by block: each side goes to every block of the other under the number of the pair,
    # so a pair is a key of its own and no task gets more than its share of pairs
    n_q, n_c = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // CANDIDATE_BLOCK))
    tasks = max(1, min(n_q * n_c, 10_000))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))).repartition(tasks, "q_block", "block")
    c = c.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).repartition(tasks, "q_block", "block")
    pairs = c.join(q.hint("shuffle_hash"), ["q_block", "block"])
    found = pairs.mapInPandas(lambda it: _best(it, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(e.select("vec_id", quantised("embedding", 256.0).alias("v")), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
