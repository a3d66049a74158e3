"""A corpus pipeline of five stages, each an operator of factledger.llm over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Between stages the rows are
written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import exact_dedup, langid, minhash, mixing, packing
from factledger.llm.shared import documents, materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null, or no letter) and those on the fence between two; a missing label is filled in. Where no document
    is labelled nothing can be learned, and only those without a letter are rejected. Columns are those of docs, whatever their names."""
    model = langid.train(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = langid.guesses(docs, model).where((F.col("guess.lang") != langid.UNKNOWN) & ~F.col("guess.ambiguous"))
    return rows.select(*[(F.coalesce("row.lang", "guess.lang") if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a similarity of at least 0.8 on shingles of five words."""
    return minhash.drop_near_duplicates(docs, width=5, threshold=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for every repetition that the mix takes."""
    return mixing.repeat_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row for each piece of a document."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact dedup", exact), ("near dedup", near), ("mix", mixed), ("pack", packed)]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
