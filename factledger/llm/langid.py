"""Language identification by error-correcting output codes.

Each language has a codeword of +-1. For each bit, a binary n-gram classifier (naive Bayes log-odds over hashed byte
n-grams of lower-cased letters) tells which side of the code a text is on. Decoding weighs every bit by its logistic loss
and takes the nearest codeword; a text whose two nearest codewords are about as near is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factledger.llm.shared import documents, edge_of, residue

BUCKETS = 1 << 16
#: Bound of the training sample, and bits of the code from 6 languages on (more above 128 languages).
DOCS_PER_LANGUAGE, LONG_CODE = 2000, 31
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1, as rows: the exhaustive code for up to 5 languages, else the best of seeded random codes by least distance between words."""
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 5:
        bits = np.array([[(c >> i) & 1 for c in range(1, max(2, 1 << (n - 1)))] for i in range(n - 1)] + [[0] * (max(2, 1 << (n - 1)) - 1)])
        return np.where(bits > 0, 1, -1)
    rng, best, least, bits = np.random.default_rng(seed), None, -1, max(LONG_CODE, 4 * n.bit_length())
    for _ in range(200):
        code = rng.choice((-1, 1), (n, bits))
        gram = code @ code.T - 2 * bits * np.eye(n, dtype=int)
        distance = (bits - gram.max()) // 2
        if distance > least and (np.abs(code.sum(0)) < n).all():
            best, least = code, distance
    return best


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte pairs and byte triples of the folded text, with a space on either side."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    pairs = (b[:-1] << 8) | b[1:]
    triples = ((((pairs[:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> 16) & 0xFFFF
    return pairs, triples


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # 2 x BUCKETS x bits, float32: log-odds of a pair and of a triple
    scale: float = 1.0

    def margins(self, text: str) -> np.ndarray:
        """Mean log-odds of each bit, over blocks, so that a very long text needs little memory."""
        total, n = np.zeros(self.code.shape[1]), 0
        for at in range(0, len(text), 1 << 18):
            for table, idx in zip(self.weights, grams(text[at : at + (1 << 18)])):
                total += table[idx].sum(0, dtype=np.float64)
                n += len(idx)
        return total / max(n, 1)

    def chances(self, z: np.ndarray) -> np.ndarray:
        loss = np.logaddexp(0, -self.code * (self.scale * z)).sum(1)
        p = np.exp(loss.min() - loss)
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        p = self.chances(self.margins(text))
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(len(p) > 1 and np.partition(p, -2)[-2] > 0.8 * p[best])


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Learns from a sample of the rows that `usable` holds for and whose language and text are not null: docs_per_language
    whole texts of each language, those with the least hashes of id and text (all, if fewer), so runs agree."""
    rows = df.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col)).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    languages = sorted(sizes)
    code = codewords(len(languages))
    model = LanguageModel(languages, code, np.zeros((2, BUCKETS, code.shape[1]), np.float32))
    if not languages:
        return model
    order = Window.partitionBy("lang").orderBy("h", "text")
    # only this share of the hashes, of which more than enough lie below the edge, is shuffled and ranked, however large a language is
    share = {name: min(1.0, (2 * docs_per_language + 200) / n) for name, n in sizes.items()}
    edges = df.sparkSession.createDataFrame([(name, edge_of(x)) for name, x in share.items()], "lang string, edge long")
    near = rows.join(F.broadcast(edges), "lang").where(F.col("h") <= F.col("edge"))  # a row for each language
    sample = near.select("lang", "text", F.row_number().over(order).alias("n")).where(F.col("n") <= docs_per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                table = found.setdefault(lang, np.zeros((2, BUCKETS)))
                for k, idx in enumerate(grams(text)):
                    np.add.at(table[k], idx, 1.0)
        for lang, table in found.items():
            yield pd.DataFrame({"lang": [lang], "counts": [table.astype("<f4").tobytes()]})

    # every language weighs the same; of each only the n-grams that it has are kept
    shares, sides = {}, np.zeros((2, 2, BUCKETS, code.shape[1]))
    for r in sample.select("lang", "text").mapInPandas(count, "lang string, counts binary").toLocalIterator():
        counts = np.frombuffer(r["counts"], "<f4").reshape(2, BUCKETS)
        own = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        shares[r["lang"]] = [(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in own]
        bits = code[languages.index(r["lang"])]
        for k, (at, x) in enumerate(shares[r["lang"]]):
            for side, sign in enumerate((1, -1)):
                sides[side, k, at[:, None], np.flatnonzero(bits == sign)] += x[:, None]
    total = np.maximum(sides.sum(2, keepdims=True), 1)
    logs = np.log((sides + 1e-6) / total)
    model.weights = (logs[0] - logs[1]).astype(np.float32)
    # the scale of the margins: such that the sampled languages' own mean margins decode with a logit of about 6 a bit
    own = np.array([np.mean([x @ model.weights[k, at] for k, (at, x) in enumerate(s)], axis=0) for s in shares.values()])
    model.scale = float(6 / max(np.median(np.abs(own)), 1e-6))
    return model


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row, from its whole text and nothing else.

    A null text or one without a letter is `und` with score 0 and flagged; so is every text if the model knows no
    language. Null and repeated ids pass through; other columns are ignored; an empty table gives an empty result.
    """
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # Arrow: ids stay whole beside nulls
        m = known.value
        for batch in batches:
            lang, score, unsure = zip(*(m.predict(t.as_py()) for t in batch.column(1))) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def guesses(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """row (all columns of df) and guess (lang, score, ambiguous), apart, so that no name clashes."""
    known = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        m = known.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang", "score", "ambiguous"])

    return df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias("row"), guess(F.col(f"`{text_col}`")).alias("guess"))


def label_rows(df: DataFrame, model: LanguageModel, text_col: str = "text", pred: str = "lang_pred", score: str = "lang_score", unsure: str = "lang_ambiguous") -> DataFrame:
    """df with the three columns added to its own, for filters; columns of these names are replaced."""
    keep = [c for c in df.columns if c not in (pred, score, unsure)]
    return guesses(df, model, text_col).select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("guess.lang").alias(pred), F.col("guess.score").alias(score), F.col("guess.ambiguous").alias(unsure))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs, residue("doc_id", 3) != 1)
    out = identify(docs, model)
    return out.select("doc_id", (residue("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
