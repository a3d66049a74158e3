"""A tree of digests over ranges of keys: what is equal needs no look, what differs is found by its range.

A fact belongs to the range that the first hex digits of its key's SHA-256 name, so ranges are even however the keys are spread, and one hot
provider is many ranges. A range's digest is that of its rows' hashes in order; sixteen ranges fold into one above them, up to the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.operators.diff import diff_keyed


def _spelled(*columns: str) -> Column:
    """Columns as one text that keeps their borders and nulls apart."""
    return F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])


def range_of(keys: list[str], digits: int) -> Column:
    return F.substring(F.sha2(_spelled(*keys), 256), 1, digits)


def digits_for(rows: int, per_range: int = 1000) -> int:
    """As many digits as keep a range at about `per_range` rows or fewer."""
    digits = 1
    while 16**digits * per_range < rows:
        digits += 1
    return digits


def range_digests(facts: DataFrame, keys: list[str], value: str = "value_json", digits: int = 3) -> DataFrame:
    """(range, facts, digest): one row for each range that has facts. A task gathers the hashes of one range at a time, some thousand (digits_for)."""
    rows = facts.select(range_of(keys, digits).alias("range"), F.sha2(_spelled(*keys, value), 256).alias("h"))
    return rows.groupBy("range").agg(F.count(F.lit(1)).alias("facts"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))


def fold_ranges(ranges: DataFrame, digits: int) -> DataFrame:
    """(range, facts, digest) of all levels: those given, and above them one for each shorter prefix, down to the root, ''. A parent's digest is that of
    its at most sixteen children, named and in order. No facts at all have no root."""
    levels = [ranges]
    for n in range(digits - 1, -1, -1):
        below = levels[-1]
        parts = F.array_sort(F.collect_list(F.concat("range", F.lit(":"), "digest")))
        levels.append(below.groupBy(F.substring("range", 1, n).alias("_p")).agg(F.sum("facts").alias("facts"), F.sha2(F.array_join(parts, ","), 256).alias("digest")).withColumnRenamed("_p", "range"))
    return reduce(DataFrame.unionByName, levels)


def changed_ranges(old: DataFrame, new: DataFrame, digits: int) -> DataFrame:
    """(range) of the lowest level whose digests differ or that only one side has."""
    at = F.length("range") == digits
    a, b = old.where(at).select("range", F.col("digest").alias("_a")), new.where(at).select("range", F.col("digest").alias("_b"))
    return a.join(b, "range", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("range")


def same_root(old: DataFrame, new: DataFrame) -> bool:
    """Whether two trees say the same: one row of each is read."""
    root = lambda t: [r["digest"] for r in t.where("range = ''").select("digest").limit(1).collect()]
    return root(old) == root(new)


def with_range(facts: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """facts with their range, dealt and sorted by it, to be written so: files and row groups then hold few ranges, and a read of some skips the rest."""
    return facts.withColumn("range", range_of(keys, digits)).repartitionByRange("range").sortWithinPartitions("range")


def ranged_diff(old: DataFrame, new: DataFrame, changed: DataFrame, keys: list[str], value: str = "value_json", most: int = 1000) -> DataFrame:
    """diff_keyed() of two tables that have a column `range`, reading only the changed ranges. While there are no more than `most` of them they are
    named to the scans, so row groups are skipped by their statistics; beyond that they are joined."""
    names = [r["range"] for r in changed.select("range").limit(most + 1).collect()]
    some = (lambda t: t.where(F.col("range").isin(names))) if len(names) <= most else (lambda t: t.join(changed.select("range"), "range", "left_semi"))
    return diff_keyed(some(old).select(*keys, value), some(new).select(*keys, value), keys, value)
