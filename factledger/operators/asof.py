"""Facts in force: reads of an append-only table of eras.

An era says that a fact (the columns `keys`) held `value_json` from `boundary` on. Eras of one fact are ordered by
(boundary, id). Every operator takes `keys`, so it works on any keyed history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions.claims import same_claim

ORDER = ("boundary", "id")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest `order`, by an aggregation with partial results (no sort, no window)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def as_of(eras: DataFrame, at: int | Column, keys: list[str]) -> DataFrame:
    """Of each fact the era in force at an instant: the greatest boundary not after it."""
    return latest_per_key(eras.where(F.col("boundary") <= at), keys, list(ORDER))


def current(eras: DataFrame, keys: list[str]) -> DataFrame:
    return latest_per_key(eras, keys, list(ORDER))


def with_intervals(eras: DataFrame, keys: list[str]) -> DataFrame:
    """valid_to: the next boundary of the same fact, null for the newest; intervals are half-open."""
    return eras.withColumn("valid_to", F.lead("boundary").over(Window.partitionBy(*keys).orderBy(*ORDER)))


def as_of_join(left: DataFrame, eras: DataFrame, on: list[str], at_col: str, value_cols: list[str], how: str = "left", bucket_ms: int | None = None) -> DataFrame:
    """For each row of left the era of its keys in force at its instant.

    Rows and eras are merged into one ordered history per key and the last era is carried forward: one shuffle, no range
    join, whatever the number of instants. At equal instants the era comes first. With bucket_ms a history is cut into stretches of
    that length, so a hot key is many tasks' work; each stretch is opened by the last era before it, which costs one row per
    stretch that has rows and a window over these. At an instant that is null, no era is in force.
    """
    carried = F.struct(*[F.col(c) for c in value_cols])
    kind = eras.select(carried.alias("x")).schema[0].dataType
    own = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*on, F.col(at_col).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_id"), own.alias("_left"), F.lit(None).cast(kind).alias("_era"))
    b = eras.select(*on, F.col("boundary").alias("_t"), F.lit(0).alias("_side"), F.col("id").cast("long").alias("_id"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), carried.alias("_era"))
    both, by = a.unionByName(b), list(on)
    if bucket_ms is not None:
        both, by = both.withColumn("_bucket", F.floor(F.col("_t") / bucket_ms)), [*on, "_bucket"]
        newest = F.max_by(F.col("_era"), F.when(F.col("_side") == 0, F.struct("_t", "_id")))
        ends = both.groupBy(*by).agg(newest.alias("_last"))
        before = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        opens = ends.withColumn("_era", F.last("_last", ignorenulls=True).over(before)).where("_era IS NOT NULL AND _bucket IS NOT NULL")
        opens = opens.select(*on, (F.col("_bucket") * bucket_ms).cast("long").alias("_t"), F.lit(-1).alias("_side"), F.lit(0).cast("long").alias("_id"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_era", "_bucket")
        both = both.unionByName(opens)
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_era", F.last("_era", ignorenulls=True).over(order)).where("_side = 1")
    if how == "inner":
        met = met.where(F.col("_era").isNotNull())
    return met.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_era")[c].alias(c) for c in value_cols])


def with_previous(eras: DataFrame, keys: list[str]) -> DataFrame:
    """previous_value and has_previous of each era."""
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    return eras.withColumn("previous_value", F.lag("value_json").over(order)).withColumn("has_previous", F.lag(F.lit(True), 1, False).over(order))


def changes(eras: DataFrame, keys: list[str]) -> DataFrame:
    """The eras whose claim differs from the one before; the first era of a fact is a change."""
    return with_previous(eras, keys).where(~F.col("has_previous") | ~same_claim(F.col("value_json"), F.col("previous_value"))).drop("has_previous", "previous_value")


def last_changed(eras: DataFrame, marked: DataFrame, at: int, keys: list[str]) -> DataFrame:
    """The last genuine change of each fact up to an instant: its newest era that is not both from a marked poll
    (marked.observation_id) and a restatement of the era before."""
    rows = with_previous(eras.where(F.col("boundary") <= at), keys)
    flagged = marked.select(F.col("observation_id").alias("_m")).distinct()
    rows = rows.join(flagged, rows["observation_id"] == flagged["_m"], "left")
    restated = F.col("has_previous") & same_claim(F.col("value_json"), F.col("previous_value"))
    return rows.where(~(F.col("_m").isNotNull() & restated)).groupBy(*keys).agg(F.max("boundary").alias("last_changed"))


def histories(eras: DataFrame, keys: list[str]) -> DataFrame:
    """All histories, each together and in order; sorted within partitions only."""
    return eras.repartition(*keys).sortWithinPartitions(*keys, *ORDER)


def select_prefixes(facts: DataFrame, prefixes: list[str] | None) -> DataFrame:
    from factledger.functions.keys import has_prefix

    return facts.where(has_prefix(F.col("fact_key"), prefixes))


def filter_presence(facts: DataFrame, entity: list[str], include_retired: bool = False) -> DataFrame:
    """Facts of entities whose existence fact says present; with include_retired also of those that say absent. An entity
    without an existence fact (withheld, say) is hidden either way."""
    states = ['"present"', '"absent"'] if include_retired else ['"present"']
    alive = facts.where((F.col("fact_key") == "existence") & F.col("value_json").isin(states)).select(*entity).distinct()
    return facts.join(alive, entity, "left_semi")
