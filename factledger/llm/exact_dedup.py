"""Exact dedup with DataFrame functions only.

Texts are grouped by the 128-bit MD5 of the normalised text *and* the normalised text itself, so the bytes inside
a hash group are compared by the aggregation and a collision makes two groups. Partial aggregation runs before the
shuffle, so thousands of copies of one text leave a task as one row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.shared import SPACES, materialise

_TWO63, _TWO65 = Decimal(2**63), Decimal(2**65)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those that agree after deleting white space; the row with the most code points in the original
    text stays, then the smallest id. A null text counts as empty (all such rows are copies of each other). A null
    id loses ties; rows that repeat an id are rows of their own in group_size, and kept is true for each row with
    the id that stays. Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(text, SPACES, "").alias("norm"), F.char_length(text).cast("decimal(10,0)").alias("n"))
    base = base.withColumn("h", F.md5("norm"))
    # (most code points, smallest id) as one number, which a hash aggregation can hold in place
    rank = F.col("n") * F.lit(_TWO65) + F.coalesce(F.lit(_TWO63) - F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(0)))
    texts = base.groupBy("h", "norm").agg(F.max(rank.cast("decimal(38,0)")).alias("top"), F.count(F.lit(1)).alias("size"))
    digest = F.sha2("norm", 256)
    groups = texts.select("h", digest.alias("text_sha256"), "top", "size").groupBy("h", "text_sha256").agg(F.max("top").alias("top"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    rest = F.col("top") % F.lit(_TWO65)
    keep = F.when(rest > 0, (F.lit(_TWO63) - rest).cast("long"))
    # two different texts that share both digests can't be told apart by the join below, so that stops the job
    safe = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256"))).otherwise(F.col("group_size"))
    # written out, so that the join deals both sides itself and can split the rows of a hot group
    groups = materialise(groups.select("h", "text_sha256", keep.alias("keep_id"), safe.alias("group_size")), "exact-groups")
    rows = base.select("doc_id", "h", digest.alias("text_sha256"))
    out = rows.join(groups, ["h", "text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns. Of rows that also share the id, one stays: of the longest texts, the first by code point."""
    names = df.columns
    id_text = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in names]).alias("row"), id_text.alias("id_text"), text.alias("raw"), F.sha2(F.regexp_replace(text, SPACES, ""), 256).alias("text_sha256"))
    kept = exact_groups(df, id_col, text_col).where("kept").select("text_sha256", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_text"))
    stay = rows.join(kept, ["text_sha256", "id_text"], "left_semi")
    # the key is an id within a digest, so this window meets only rows that repeat an id
    order = Window.partitionBy("text_sha256", "id_text").orderBy(F.char_length("raw").desc(), "raw")
    best = stay.withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select(*[F.col("row").getField(c).alias(c) for c in names])


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, arg_min(doc_id, {'n': -n, 'd': doc_id}) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g ON d.norm = g.norm
"""
