"""Source divergence audit: how far the word use of each source lies from that of every other source of its language, and by which terms.

Count-level bitmaps: the kept terms of a language are dealt to words of 64 bits; for each (source, count) a word holds the bits of
the terms that occur there so often. AND and popcount of two such words give a joint cell of a pair of sources, which is multiplied
by the cell's value; terms that a source doesn't have are counted by complement. Terms of like frequency share a word, so a word of
rare terms has few levels for many terms.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factledger.llm.shared import documents, materialise

#: What keeps a term and ends the report of terms, and the scale of shares: production parameters.
LEAST_DOCS, TOP, SCALE, SMOOTH = 10, 10, 1_000_000_000, 2
#: Terms of a group that is handled at once (a few more by chance), distinct terms that a task counts before it hands them on, and bytes of one text that are split at once.
GROUP, HELD, STEP = 4096, 200_000, 1 << 22
_TERM, _BORDER = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def split_terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, letters A-Z lower-cased, about STEP bytes at a time: runs of ASCII letters and all that isn't ASCII."""
    text = text.lower()
    at = 0
    while at < len(text):
        cut = _BORDER.search(text, at + STEP)
        to = cut.start() if cut else len(text)
        yield _TERM.findall(text, at, to)
        at = to


def count_terms(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term, summed over what a task holds before it is full, so
    a term of each group may stand in several rows. Every group has a row with the empty term. Nulls count as ''."""
    rows = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    def flush(counts: dict) -> pa.RecordBatch:
        keys = [(g, t) for g, (n, _) in counts.items() for t in n]
        columns = [
            pa.array([g[0] for g, _ in keys], pa.string()), pa.array([g[1] for g, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.binary()).cast(pa.string()),
            pa.array([counts[g][0][t] for g, t in keys], pa.int64()), pa.array([counts[g][1][t] for g, t in keys], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = defaultdict(lambda: (Counter(), Counter()))
        since = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for g, text in zip(zip(langs, sources), batch.column(2)):
                n, docs = counts[g]
                before = len(n)
                if not n:
                    n[b""] = docs[b""] = 0
                seen: set[bytes] = set()
                for terms in split_terms(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                since += len(n) - before
                if since > HELD:
                    yield flush(counts)
                    counts.clear()
                    since = 0
        if counts:
            yield flush(counts)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """The share of a term, smoothed, as a whole number of parts of SCALE; at least 1. Exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(n + SMOOTH)
    return F.call_function("div", top, wide(total + SMOOTH * terms)) + 1


def gap(p: Column, q: Column) -> Column:
    """(p - q)^2 / (p + q), rounded down: what one term adds to the divergence."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _share(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    if len(n) and int(n.max()) > 9_000_000_000:  # above what 64 bits hold
        return np.array([SCALE * (int(a) + SMOOTH) // (int(b) + SMOOTH * terms) + 1 for a, b in zip(n, total)], np.int64)
    return SCALE * (n + SMOOTH) // (total + SMOOTH * terms) + 1


def joint_values(word: np.ndarray, source: np.ndarray, count: np.ndarray, bits: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The sum of gaps over the terms of some words, for each pair of sources: rows (word, source, count > 0, bits), total of each source, terms of
    the language. Sources are 0, 1, ... and may have no row."""
    k = len(total)
    zero = _share(np.zeros(k, np.int64), total, terms)
    out = np.zeros((k, k), np.int64)
    order = np.argsort(word, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(word[order])) + 1).tolist(), len(order)]
    for a, b in zip(edges, edges[1:]):
        rows = order[a:b]
        if not len(rows):
            continue
        s, x = source[rows], bits[rows]
        p = _share(count[rows], total[s], terms)
        size = np.bitwise_count(x).astype(np.int64)
        here = int(np.bitwise_count(np.bitwise_or.reduce(x)))  # every kept term occurs somewhere
        have = np.zeros(k, np.int64)
        np.add.at(have, s, size)
        both = np.zeros((k, k), np.int64)
        only = np.zeros((k, k), np.int64)
        step = max(1, (1 << 21) // len(rows))
        for at in range(0, len(rows), step):
            cells = np.bitwise_count(x[at : at + step, None] & x[None, :])
            i, j = np.nonzero(cells)
            n = cells[i, j].astype(np.int64)
            i += at
            np.add.at(out, (s[i], s[j]), n * _gap(p[i], p[j]))
            np.add.at(both, (s[i], s[j]), n)
            met = np.zeros((min(step, len(rows) - at), k), np.int64)
            np.add.at(met, (i - at, s[j]), n)
            mine = slice(at, at + step)
            np.add.at(only, s[mine], (size[mine, None] - met) * _gap(p[mine, None], zero[None, :]))  # the other source has it not
        none = here - have[:, None] - have[None, :] + both
        out += only + only.T + none * _gap(zero[:, None], zero[None, :])
    return out


def _pair_values(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of part of the terms; levels(lang, bucket, word, source, n, bits), groups(lang, bucket, source, total, terms): every source for every bucket."""

    def run(mine: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        names = sorted(every["source"])
        if not names:  # cannot be: a bucket comes from its language's groups
            raise ValueError("a bucket without groups")
        number = {s: i for i, s in enumerate(names)}
        total = np.zeros(len(names), np.int64)
        total[[number[s] for s in every["source"]]] = every["total"]
        source = np.fromiter((number[s] for s in mine["source"]), np.int64, len(mine))
        value = joint_values(mine["word"].to_numpy(np.int64), source, mine["n"].to_numpy(np.int64), mine["bits"].to_numpy(np.int64).view(np.uint64), total, int(every["terms"].iloc[0]))
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        texts = np.array(names, object)
        return pd.DataFrame({"lang": every["lang"].iloc[0], "source": texts[a], "item": texts[b], "value": value[a, b]})

    keys = ["lang", "bucket"]
    return levels.groupBy(*keys).cogroup(groups.groupBy(*keys)).applyInPandas(run, "lang string, source string, item string, value long")


def divergence(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language and the divergence from it over all kept terms
    (0 where none is kept). Part `term`: the terms by which the source stands above its language, the `top` first.

    A term is a run of ASCII letters, lower-cased, and of all characters that aren't ASCII; a language keeps those in at least `least_docs` of its rows.
    Null text, language and source count as ''. Rows that repeat an id are documents of their own; other columns are not read. A group whose
    texts have no kept term has shares of its smoothing alone. An empty table gives an empty result.
    """
    keys = ["lang", "term"]
    counted = count_terms(df, lang_col, source_col, text_col).repartition(*keys)  # sums by source need no other exchange
    by_term = Window.partitionBy(*keys)
    cells = counted.groupBy(*keys, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = cells.withColumn("all_docs", F.sum("docs").over(by_term)).withColumn("all_n", F.sum("n").over(by_term)).withColumn("first", F.row_number().over(by_term.orderBy("source")) == 1)
    cells = materialise(cells.where((F.col("all_docs") >= least_docs) | (F.col("term") == "")).select(*keys, "source", "n", "all_n", "first"), "divergence-cells")
    # one row per group: its sum over kept terms, and the kept terms that it is the first source of
    sums = materialise(cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("first") & (F.col("term") != "")).alias("first")), "divergence-groups")
    of_lang = Window.partitionBy("lang")
    groups = sums.select("lang", "source", "total", F.sum("first").over(of_lang).alias("terms"), F.sum("total").over(of_lang).alias("lang_total"))
    langs = sums.groupBy("lang").agg(F.sum("first").alias("terms")).withColumn("buckets", F.ceil(F.col("terms") / GROUP))
    kept = cells.where("term <> ''").join(langs.select("lang", "buckets"), "lang")
    kept = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")))
    place = F.dense_rank().over(Window.partitionBy("lang", "bucket").orderBy(F.desc("all_n"), "term")) - 1  # a bucket holds about GROUP terms
    placed = kept.withColumn("place", place)
    word, bit = F.floor(F.col("place") / 64).cast("long"), (F.col("place") % 64).cast("int")
    levels = placed.groupBy("lang", "bucket", word.alias("word"), "source", "n").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    buckets = langs.where("buckets > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    some = _pair_values(levels, groups.select("lang", "source", "total", "terms").join(buckets, "lang"))
    summed = some.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", "source").join(sums.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # the report has a row for each
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(own).alias("rank"))
    stated = cells.where("term <> '' AND n > 0").join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all_n"), F.col("lang_total"), F.col("terms"))
    stated = stated.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = stated.select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS row_id FROM documents),
o AS (SELECT row_id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM o GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(all_n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN k USING (lang) GROUP BY l.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.all_n + 2)) // (v.n + 2 * v.v) AS q
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
