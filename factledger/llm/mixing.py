"""Mixing sources to target weights by capped water-filling.

Each source wants its weight's share of the budget, is clamped at `max_epochs` times its own size, and the excess goes
to the others by weight until no target is above its clamp. That fixed point has a closed form: order the sources by
clamp / weight; a source is clamped exactly when the level at which it fills is reachable with the budget. A source
then takes whole repetitions of all its documents and one more of those that come first in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.shared import WORD, materialise

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
FACTS = ["size", "source_size", "target", "whole", "times", "taken"]


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_col: str, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """totals(source, source_size) with a column target. One row per source, so the windows over all of it stay small."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.select("source", "source_size", weight.alias("w"), (F.col("source_size") * epochs).alias("clamp"))
    t = t.withColumn("level", F.col("clamp").cast("double") / F.col("w")).withColumn("budget", F.sum("source_size").over(everything).cast("double") * share)
    upto = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("below", F.sum("clamp").over(upto).cast("double")).withColumn("above_w", F.sum("w").over(everything) - F.sum("w").over(upto))
    t = t.withColumn("full", F.col("below") + F.col("level") * F.col("above_w") <= F.col("budget"))
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("clamp"))).over(everything), F.lit(0)).cast("double")
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("clamp").cast("double")).otherwise((F.col("budget") - spent) / open_w * F.col("w"))
    return t.select("source", "source_size", target.alias("target"))


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From sizes(source, size, key) one row per source: source_size, target, whole (repetitions of every document) and
    cutoff (documents whose key is not above it get one repetition more).

    The cutoff comes from prefix sums over cells of the key, 256 and then 256 to a source, and the rows of the one cell
    that holds the boundary; so no source, however hot, is sorted in one task.
    """
    sizes = sizes.groupBy("source", "key").agg(F.sum("size").alias("size")).withColumn("c1", F.substring("key", 1, 2)).withColumn("c2", F.substring("key", 1, 4))
    goal = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = materialise(goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goal")

    def before(cols: list[str], order: str) -> Column:
        return F.coalesce(F.sum("size").over(Window.partitionBy(*cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def boundary(cells: DataFrame, start: DataFrame, order: str) -> DataFrame:
        """The cell of each source in which `rest` lies, with what lies before it. start(source, rest, base)."""
        near = cells.join(start, cells["source"].eqNullSafe(start["s"])).drop("s")
        near = near.withColumn("base", F.col("base") + before(["source"], order))
        return near.where((F.col("base") <= F.col("rest")) & (F.col("rest") < F.col("base") + F.col("size")))

    fine = sizes.groupBy("source", "c1", "c2").agg(F.sum("size").alias("size"))
    coarse = fine.groupBy("source", "c1").agg(F.sum("size").alias("size"))
    first = boundary(coarse, goal.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("base")), "c1").select(F.col("source").alias("s"), F.col("c1").alias("cell"), "rest", "base")
    inside = fine.join(first, fine["source"].eqNullSafe(first["s"]) & (fine["c1"] == first["cell"]))
    inside = inside.withColumn("base", F.col("base") + before(["source"], "c2"))
    second = inside.where((F.col("base") <= F.col("rest")) & (F.col("rest") < F.col("base") + F.col("size"))).select(F.col("source").alias("s"), F.col("c2").alias("cell"), "rest", "base")
    last = sizes.join(second, sizes["source"].eqNullSafe(second["s"]) & (sizes["c2"] == second["cell"]))
    last = last.withColumn("base", F.col("base") + before(["source"], "key"))
    taken = F.when(F.col("base") + F.col("size") / 2 <= F.col("rest"), F.col("key"))
    cutoff = last.groupBy("source").agg(F.coalesce(F.max(taken), F.max("cell")).alias("cutoff")).withColumnRenamed("source", "s")
    plan = goal.join(cutoff, goal["source"].eqNullSafe(cutoff["s"]), "left").select(goal["source"], "source_size", "target", "whole", "cutoff")
    return materialise(plan, "mix-plan")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """df with size, source_size, target, whole, times (repetitions that the mix takes of the row) and taken (its words).

    Weights go to the sources by code point, a null source last. A null text has size 0; a source of size 0 has target 0.
    Rows that repeat an id move together. Sources' taken words miss their target by at most half of one document (or of
    the rows that share its id). Columns of df that have one of these names are replaced. An empty table stays empty.
    """
    keep = [c for c in df.columns if c not in FACTS]
    return _mixed(df, keep, id_col, text_col, source_col, weights, share, epochs, seed).select(*[F.col("row").getField(c).alias(c) for c in keep], *FACTS)


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """What mix() adds, beside the id alone; every text is read and counted once."""
    out = _mixed(df, [id_col], id_col, text_col, source_col, weights, share, epochs, seed)
    return out.select(F.col("row").getField(id_col).alias(id_col), *FACTS)


def _mixed(df: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, epochs: int, seed: str) -> DataFrame:
    """row (the columns `keep`) beside the columns of mix(); apart, so that no name clashes. Rows without their text are written out
    with their sizes; rows with it are counted again rather than written whole."""
    facts = df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("row"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text_col).alias("size"), order_key(id_col, seed).alias("key"))
    if text_col not in keep:
        facts = materialise(facts, "mix-sizes")
        sizes = facts.select("source", "size", "key")
    else:
        sizes = materialise(facts.select("source", "size", "key"), "mix-sizes")
    per_source = plan_mix(sizes, weights, share, epochs)
    per_source = per_source.select(F.col("source").alias("s"), "source_size", "target", "whole", "cutoff")
    out = facts.join(per_source, facts["source"].eqNullSafe(per_source["s"]))
    extra = F.when(F.col("key") <= F.col("cutoff"), 1).otherwise(0)
    return out.withColumn("times", (F.col("whole") + extra).cast("long")).withColumn("taken", F.col("size") * F.col("times"))


def repeat_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of df as many times as the mix takes it, with all columns of df as they were, whatever their names."""
    out = _mixed(df, df.columns, id_col, text_col, source_col, weights, share, epochs, seed).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).select(*[F.col("row").getField(c).alias(c) for c in df.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2 AS clamp, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((r - 1) % 3 + 1)::INT] AS w, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, clamp::DOUBLE / w AS level FROM w),
f AS (SELECT *, (sum(clamp) OVER u)::DOUBLE + level * (sum(w) OVER () - sum(w) OVER u) <= budget AS isfull FROM l WINDOW u AS (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, source_size, CASE WHEN isfull THEN clamp::DOUBLE ELSE (budget - coalesce(sum(CASE WHEN isfull THEN clamp END) OVER (), 0)::DOUBLE) / (sum(CASE WHEN NOT isfull THEN w END) OVER ()) * w END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN base + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
