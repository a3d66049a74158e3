"""Corrections and uncertainty: what is known to be wrong, or not known, about a past instant.

A correction covers a closed window [from_ms, until_ms] of a fact. The time of a change is known only to lie after the
last confirming poll before it and not after its boundary, so the open interval (prior, boundary) is uncertain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions.claims import same_claim
from factledger.operators.asof import as_of, as_of_join, latest_per_key
from factledger.operators.intervals import stab


def corrections_at(corrections: DataFrame, at: int) -> DataFrame:
    """All records that cover the instant, both ends included."""
    return corrections.where((F.col("from_ms") <= at) & (F.col("until_ms") >= at))


def corrections_covering(points: DataFrame, corrections: DataFrame, keys: list[str], at_col: str) -> DataFrame:
    """points x the records that cover them, for many instants, through the index of intervals: some fifty rows for a window at most,
    whether it spans an hour or ten years."""
    return stab(points, corrections, keys, at_col)


def withhold(facts: DataFrame, covering: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts that stay, facts withheld since a correction covers them)."""
    hit = covering.select(*keys).distinct()
    return facts.join(hit, keys, "left_anti"), facts.join(hit, keys, "left_semi")


def uncertain(facts: DataFrame, eras: DataFrame, at: int, keys: list[str]) -> DataFrame:
    """Facts of the as-of result with a later era whose change may already have happened: prior < at < boundary, both open.
    One row per such era: keys, prior_ms, boundary."""
    near = eras.where((F.col("prior_ms") < at) & (F.col("boundary") > at)).select(*keys, "prior_ms", "boundary")
    return near.join(facts.select(*keys).hint("merge"), keys, "left_semi")  # as many as there are facts


def value_at(eras: DataFrame, corrections: DataFrame, at: int, keys: list[str]) -> DataFrame:
    """Every fact ever recorded by an instant's state: corrected, unknown (nothing yet), known_stale (a change may already
    have happened) or known, with the value where there is one."""
    every = eras.select(*keys).distinct()
    now = as_of(eras, at, keys).select(*keys, "value_json", F.lit(True).alias("_has"))
    fixed = corrections_at(corrections, at).select(*keys).distinct().withColumn("_fixed", F.lit(True))
    stale = eras.where((F.col("prior_ms") < at) & (F.col("boundary") > at)).select(*keys).distinct().withColumn("_stale", F.lit(True))
    out = every.join(now, keys, "left").join(fixed, keys, "left").join(stale, keys, "left")
    state = F.when(F.col("_fixed"), "corrected").when(F.col("_has").isNull(), "unknown").when(F.col("_stale"), "known_stale").otherwise("known")
    return out.select(*keys, state.alias("state"), F.when(state.isin("known", "known_stale"), F.col("value_json")).alias("value_json"))


def value_at_detail(eras: DataFrame, corrections: DataFrame, at: int, keys: list[str]) -> DataFrame:
    """value_at with what stands behind a state: of known_stale the bracket in which the next change happened (changed_after, changed_by;
    open), of corrected how many records cover the instant and the newest (by record) of them."""
    stale = eras.where((F.col("prior_ms") < at) & (F.col("boundary") > at)).groupBy(*keys).agg(F.min(F.struct("boundary", "prior_ms")).alias("_next"))
    fixed = corrections_at(corrections, at).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("record", "from_ms", "until_ms")).alias("_fix"))
    out = value_at(eras, corrections, at, keys).join(stale, keys, "left").join(fixed, keys, "left")
    known_stale = F.col("state") == "known_stale"
    return out.select(*keys, "state", "value_json", F.when(known_stale, F.col("_next.prior_ms")).alias("changed_after"), F.when(known_stale, F.col("_next.boundary")).alias("changed_by"), F.coalesce("_n", F.lit(0)).alias("records"), F.col("_fix.record").alias("record"), F.col("_fix.from_ms").alias("from_ms"), F.col("_fix.until_ms").alias("until_ms"))


def plan_corrections(requests: DataFrame, eras: DataFrame, corrections: DataFrame, keys: list[str], addressable: Column | None = None, together: list[str] | None = None) -> DataFrame:
    """requests(keys, from_ms, until_ms, reason) with current value, current_since and `refusals`, an array of the first reason against
    the request, or none: bad_window; not_addressable; no_such_fact; present_still_affected (the era in force began before the
    window ended, so what is served now would be marked wrong; one that begins just there is the ordinary case); unchanged (the
    claim at the window's start and every era in it restate the current claim); already_recorded (same window and reason).
    together: columns that make requests one plan; where one of these is refused, the others say plan_refused."""
    now = latest_per_key(eras, keys, ["boundary", "id"]).select(*keys, F.col("value_json").alias("current_value"), F.col("boundary").alias("current_since"))
    window = [*keys, "from_ms", "until_ms"]
    # eras of the facts asked for, each with the number of eras up to it that say something else than the newest: a window's own are a difference
    # of two as-of reads, so windows and eras are never paired
    asked = requests.select(*window).distinct()
    told = eras.select(*keys, "boundary", "id", "value_json").join(asked.select(*keys).distinct(), keys, "left_semi").join(now.select(*keys, "current_value"), keys)
    upto = Window.partitionBy(*keys).orderBy("boundary", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    differs = F.when(same_claim(F.col("value_json"), F.col("current_value")), 0).otherwise(1)
    told = told.select(*keys, "boundary", "id", F.col("value_json").alias("_entering"), F.sum(differs).over(upto).alias("_n"))
    met = as_of_join(asked, told.withColumnRenamed("_n", "_n0"), keys, "from_ms", ["_entering", "_n0"])
    met = as_of_join(met, told.withColumnRenamed("_n", "_n1"), keys, "until_ms", ["_n1"])
    met = met.select(*window, "_entering", (F.coalesce("_n1", F.lit(0)) > F.coalesce("_n0", F.lit(0))).alias("_moved"))
    known = corrections.select(*window, "reason").distinct().withColumn("_known", F.lit(True))
    r = requests.join(now, keys, "left").join(met, window, "left").join(known, [*window, "reason"], "left")
    ok = F.lit(True) if addressable is None else addressable
    reason = (
        F.when(F.col("from_ms") > F.col("until_ms"), "bad_window")
        .when(~ok, "not_addressable")
        .when(F.col("current_since").isNull(), "no_such_fact")
        .when(F.col("current_since") < F.col("until_ms"), "present_still_affected")
        .when(F.col("_entering").isNotNull() & same_claim(F.col("_entering"), F.col("current_value")) & ~F.coalesce("_moved", F.lit(False)), "unchanged")
        .when(F.col("_known"), "already_recorded")
    )
    r = r.withColumn("refusals", F.array_compact(F.array(reason))).drop("_entering", "_moved", "_known")
    if together:
        bad = r.where(F.size("refusals") > 0).select(*together).distinct().withColumn("_bad", F.lit(True))
        r = r.join(bad, together, "left").withColumn("refusals", F.when(F.col("_bad") & (F.size("refusals") == 0), F.array(F.lit("plan_refused"))).otherwise(F.col("refusals"))).drop("_bad")
    return r


def apply_corrections(plan: DataFrame, eras: DataFrame, now: int, keys: list[str]) -> DataFrame:
    """New eras of kind corrected for the plan's accepted rows; they carry the current value, so the present stays as it is. A fact that
    moved since the planning stops the job: the plan was made against a state that is no more, and none of it is written."""
    latest = as_of(eras, now, keys).select(*keys, F.col("boundary").alias("_since"))
    ok = plan.where((F.size("refusals") == 0) & (F.col("until_ms") <= now)).join(latest, keys, "left")
    still = F.col("_since").eqNullSafe(F.col("current_since"))
    moved = F.raise_error(F.concat(F.lit("a fact has changed since the plan was made: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    value = F.when(still, F.col("current_value")).otherwise(moved)
    return ok.select(*keys, value.alias("value_json"), F.lit(now).cast("long").alias("boundary"), F.lit("corrected").alias("kind"), "from_ms", "until_ms", "reason")


def change_instants(eras: DataFrame, corrections: DataFrame, entity: list[str], *others: DataFrame) -> DataFrame:
    """(entity, at): every instant at which a read may differ. A correction's closed end counts one millisecond later."""
    parts = [eras.select(*entity, F.col("boundary").alias("at")), corrections.select(*entity, F.col("from_ms").alias("at")), corrections.select(*entity, (F.col("until_ms") + 1).alias("at"))]
    parts += [o.select(*entity, "at") for o in others]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def timeline(states: DataFrame, entity: list[str], at_col: str, claim_cols: list[str]) -> DataFrame:
    """Contiguous segments of equal claims: (entity, claims, from_at, to_at), to_at null for the last; neighbours differ."""
    order = Window.partitionBy(*entity).orderBy(at_col)
    claim = F.struct(*claim_cols)
    first = F.lag(F.lit(1)).over(order).isNull()
    starts = states.withColumn("_new", first | ~claim.eqNullSafe(F.lag(claim).over(order))).where("_new")
    return starts.select(*entity, *claim_cols, F.col(at_col).alias("from_at"), F.lead(at_col).over(order).alias("to_at"))


def served_timeline(eras: DataFrame, corrections: DataFrame, keys: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """What a fact was served as, as contiguous segments (keys, from_ms, until_ms, state, value, source, reason), neighbours differ; until_ms is
    null for the last. state: value; absent (recorded, but nothing in force); refused (a correction covers the instant). source: upstream, or
    override where overrides(keys, value, replaces, boundary, id; value null: withdrawn) had one in force whose `replaces` is what upstream
    said (null: it said nothing). A timeline begins with the first era of its fact."""
    told = eras.select(*keys, F.col("boundary").alias("at")).unionByName(corrections.select(*keys, F.col("from_ms").alias("at"))).unionByName(corrections.select(*keys, (F.col("until_ms") + 1).alias("at")))
    if overrides is not None:
        told = told.unionByName(overrides.select(*keys, F.col("boundary").alias("at")))
    begins = eras.groupBy(*keys).agg(F.min("boundary").alias("_begin"))
    at = told.distinct().join(begins, keys).where(F.col("at") >= F.col("_begin")).drop("_begin")
    rows = as_of_join(at, eras.select(*keys, "boundary", "id", F.col("value_json").alias("_up")), keys, "at", ["_up"])
    source, value = F.lit("upstream"), F.col("_up")
    if overrides is not None:
        o = overrides.select(*keys, "boundary", "id", F.struct("value", "replaces").alias("_o"))
        rows = as_of_join(rows, o, keys, "at", ["_o"])
        fits = F.when(F.col("_o.replaces").isNull(), F.col("_up").isNull() | (F.col("_up") == "null")).otherwise(same_claim(F.col("_up"), F.col("_o.replaces")))
        hit = F.coalesce(F.col("_o.value").isNotNull() & fits, F.lit(False))
        source, value = F.when(hit, "override").otherwise("upstream"), F.when(hit, F.col("_o.value")).otherwise(F.col("_up"))
    covered = corrections_covering(rows.select(*keys, "at"), corrections.select(*keys, "from_ms", "until_ms"), keys, "at").select(*keys, "at").distinct().withColumn("_hit", F.lit(True))
    rows = rows.join(covered, [*keys, "at"], "left")
    state = F.when(F.col("_hit"), "refused").when(value.isNull() | (value == "null"), "absent").otherwise("value")
    shown = state == "value"
    rows = rows.select(*keys, "at", state.alias("state"), F.when(shown, value).alias("value"), F.when(shown, source).alias("source"), F.when(state == "refused", "correction").alias("reason"))
    out = timeline(rows, keys, "at", ["state", "value", "source", "reason"])
    return out.withColumnsRenamed({"from_at": "from_ms", "to_at": "until_ms"})
