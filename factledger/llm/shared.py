"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts: space, and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a folder of our own, but only in local mode: on a cluster
    the executors would write to disks that nobody else reads."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="factledger-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut and survives lost executors,
    and the size of the table is known to the planner (which then broadcasts it only if it is small)."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def residue(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the fold of the contracts. A null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def edge_of(share: float) -> int:
    """The value that this share of all 64-bit hashes does not exceed."""
    return min(2**63 - 1, -(2**63) + int(share * 2**64))


def least(rows: DataFrame, h: str, k: int, n: int) -> DataFrame:
    """k rows with the least values of the 64-bit hash h, of n rows in all; of rows that share the k-th value as many as still fit. Only hashes below an
    edge that more than k surely lie under are ranked, so one task gets some k numbers however many rows there are, or repeat."""
    if k >= n:
        return rows
    if k <= 0:
        return rows.limit(0)
    share = (2 * k + 200) / n
    while True:
        edge = edge_of(min(share, 1.0))
        got = rows.where(F.col(h) <= edge).select(h).orderBy(h).limit(k).agg(F.count(F.lit(1)), F.max(h)).first()
        if got[0] == k or share >= 1:
            return rows.where(F.col(h) <= (-(2**63) if got[1] is None else got[1])).orderBy(h).limit(k)
        share *= 16  # rows that repeat leave fewer hashes below an edge than it promises
