"""The ledger's logs: polls (observations), versions, judgments, curated histories, prices; and reports about them.

Poll-level windows run over one row per poll and are partitioned by source, so they are bounded by polls, not facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions.claims import same_claim
from factledger.operators.asof import as_of, as_of_join, latest_per_key, with_previous

CONFIRMING = ("changed", "unchanged", "not_modified", "seeded")


def prior_confirming(obs: DataFrame, by: list[str]) -> DataFrame:
    """prior_ms: the last confirming poll before each poll; failed polls do not count."""
    order = Window.partitionBy(*by).orderBy("observed_at_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    return obs.withColumn("prior_ms", F.last(F.when(F.col("outcome").isin(*CONFIRMING), F.col("observed_at_ms")), ignorenulls=True).over(order))


def streaks(obs: DataFrame, by: list[str]) -> DataFrame:
    """streak: consecutive failed polls up to and with each poll (0 at a confirming one)."""
    order = Window.partitionBy(*by).orderBy("observed_at_ms", "id")
    island = obs.withColumn("_island", F.sum(F.when(F.col("outcome").isin(*CONFIRMING), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*by, "_island").orderBy("observed_at_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(F.when(F.col("outcome") == "failed", 1).otherwise(0)).over(within)).drop("_island")


def _instants(obs: DataFrame, by: list[str]) -> DataFrame:
    """One row per source: bounds, and every poll since the last confirmation or failure counted with one window over the polls."""
    ok, bad = F.col("outcome").isin(*CONFIRMING), F.col("outcome") == "failed"
    last = Window.partitionBy(*by)
    written = F.max(F.when(F.col("outcome") != "unrecorded", F.col("observed_at_ms"))).over(last)
    told = obs.withColumn("_written", written).withColumn("_ok", F.max(F.when(ok, F.col("observed_at_ms"))).over(last)).withColumn("_bad", F.max(F.when(bad, F.col("observed_at_ms"))).over(last))
    at = F.col("observed_at_ms")
    return told.groupBy(*by).agg(
        F.max(at).alias("last_attempt_ms"), F.max("_ok").alias("last_confirmed_ms"), F.max("_bad").alias("last_failed_ms"), F.count_if(bad).alias("failures"),
        F.count_if(bad & (F.col("_ok").isNull() | (at > F.col("_ok")))).alias("failing"), F.count_if(at > F.col("_bad")).alias("polls_since"),
        F.count_if(F.col("_written").isNull() | (at > F.col("_written"))).alias("unrecorded"),
        F.max_by("failure_class", F.when(bad, F.struct("observed_at_ms", "id"))).alias("last_class"),
    )


def freshness(obs: DataFrame, now: int, by: list[str], stale_ms: int = 7_200_000, failures: int = 4, idle_ms: int = 4_200_000, unconfirmed: bool = True) -> DataFrame:
    """Per source: the last attempt and confirmation, the failures since, and a status, the first that holds: unrecorded (the newest two polls or
    more could not be written down, outcome unrecorded), silent (no attempt for too long), stale (the last confirmation is too old),
    failing (too many failures in a row), fresh. A source that has never been confirmed is not stale: it may just have started. Its failures count
    from its first poll on, or, without `unconfirmed`, not at all: there is no confirmation that they follow."""
    out = _instants(obs, by)
    if not unconfirmed:
        out = out.withColumn("failing", F.when(F.col("last_confirmed_ms").isNull(), F.lit(0).cast("long")).otherwise(F.col("failing")))
    status = F.when(F.col("unrecorded") >= 2, "unrecorded").when(F.lit(now) - F.col("last_attempt_ms") > idle_ms, "silent").when(F.lit(now) - F.col("last_confirmed_ms") > stale_ms, "stale").when(F.col("failing") >= failures, "failing").otherwise("fresh")
    return out.select(*by, "last_attempt_ms", "last_confirmed_ms", "failing", status.alias("status"))


def failure_history(obs: DataFrame, by: list[str]) -> DataFrame:
    """Failures of every source: how many, the last instant and class, and the polls since (0 where none failed)."""
    return _instants(obs, by).select(*by, "failures", "last_failed_ms", "last_class", "polls_since")


def read_observations(obs: DataFrame, since: int | None = None, before: int | None = None, n: int | None = None) -> DataFrame:
    """Polls from an instant on and before another, the newest n of them if given, newest first."""
    rows = obs if since is None else obs.where(F.col("observed_at_ms") >= since)
    rows = rows if before is None else rows.where(F.col("observed_at_ms") < before)
    rows = rows.orderBy(F.desc("observed_at_ms"), F.desc("id"))
    return rows if n is None else rows.limit(n)


def recent(obs: DataFrame, n: int) -> DataFrame:
    return obs.orderBy(F.desc("observed_at_ms"), F.desc("id")).limit(n)


def last_non_null(obs: DataFrame, col: str, by: list[str]) -> DataFrame:
    """The newest value of every source; null for a source that never had one."""
    return obs.groupBy(*by).agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.struct("observed_at_ms", "id"))).alias(col))


def poll_composition(eras: DataFrame, entity: list[str], poll: str = "observation_id") -> DataFrame:
    """Per poll: eras, arrived and withdrawn entities, and facts changed (eras of entities whose existence did not move).
    One aggregation per (poll, entity), then one per poll; no correlated look-ups."""
    mark = lambda state: F.max(F.when((F.col("fact_key") == "existence") & (F.col("value_json") == state), 1).otherwise(0))
    each = eras.groupBy(poll, *entity).agg(F.count(F.lit(1)).alias("eras"), mark('"present"').alias("arrived"), mark('"absent"').alias("gone"))
    still = F.when((F.col("arrived") == 0) & (F.col("gone") == 0), F.col("eras")).otherwise(0)
    return each.groupBy(poll).agg(F.sum("eras").alias("eras"), F.sum("arrived").alias("arrived"), F.sum("gone").alias("withdrawn"), F.sum(still).alias("facts_changed"))


def restating(eras: DataFrame, keys: list[str], poll: str = "observation_id") -> DataFrame:
    """Per poll with any: eras that repeat the claim before them, all eras, and the fraction."""
    rows = with_previous(eras, keys).where("kind = 'observed'")
    again = F.col("has_previous") & same_claim(F.col("value_json"), F.col("previous_value"))
    by = rows.groupBy(poll).agg(F.count(F.lit(1)).alias("eras"), F.count_if(again).alias("restated"))
    return by.where("restated > 0").withColumn("fraction", F.col("restated") / F.col("eras"))


def live_marks(events: DataFrame, poll: str = "observation_id") -> DataFrame:
    """Polls whose newest mark / retract event is a mark."""
    return events.groupBy(poll).agg(F.max_by("action", "id").alias("action")).where("action = 'mark'").select(poll)


def mark_artifacts(requests: DataFrame, events: DataFrame, evidence: DataFrame, poll: str = "observation_id") -> DataFrame:
    """requests(poll, action, reason) that take effect, with the number of restated eras as evidence; a retraction without a
    live mark and a repeated mark do nothing."""
    marked = live_marks(events, poll).withColumn("_live", F.lit(True))
    r = requests.join(marked, poll, "left").where(F.when(F.col("action") == "mark", F.col("_live").isNull()).otherwise(F.col("_live")))
    return r.drop("_live").join(evidence.select(poll, "restated"), poll, "left").withColumn("restated", F.coalesce("restated", F.lit(0)))


def versions(batches: DataFrame, start: int = 0) -> DataFrame:
    """batches(id, now_ms) -> version: max(now, version before + 1), in closed form: the running maximum of now - n, plus n.
    One row per write batch."""
    order = Window.partitionBy().orderBy("id")
    n = F.row_number().over(order)
    top = F.max(F.col("now_ms") - n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return batches.withColumn("version", F.greatest(F.lit(start).cast("long"), top) + n)


def latest_judgments(log: DataFrame, keys: list[str], at: int | None = None, recorded: str = "recorded_at_ms") -> DataFrame:
    """Of each key the newest insertion (by id), as of an instant if given; withdrawn ones are hidden."""
    rows = log if at is None else log.where(F.col(recorded) <= at)
    return latest_per_key(rows, keys, ["id"]).where("withdrawn = 0")


def append_judgments(requests: DataFrame, log: DataFrame, keys: list[str], value: str = "grade") -> tuple[DataFrame, DataFrame]:
    """(rows to append, refusals with reasons): a grade must be a positive number, a withdrawal must have something to
    withdraw, and a row that changes nothing is refused."""
    now = latest_judgments(log, keys).select(*keys, F.col(value).alias("_now"), F.lit(True).alias("_live"))
    number = F.col(value).try_cast("decimal(38,18)")
    r = requests.join(now, keys, "left").withColumn("reasons", F.array_compact(F.array(
        F.when((F.col("withdrawn") == 0) & F.coalesce(number <= 0, F.lit(True)), "not_a_positive_number"),
        F.when((F.col("withdrawn") == 1) & F.col("_live").isNull(), "nothing_to_withdraw"),
        F.when((F.col("withdrawn") == 0) & F.col("_now").eqNullSafe(F.col(value)), "no_change"),
    )))
    return r.where(F.size("reasons") == 0).select(*requests.columns), r.where(F.size("reasons") > 0).select(*requests.columns, "reasons")


def curated_at(eras: DataFrame, at: int, keys: list[str], tombstones: bool = False) -> DataFrame:
    """Newest boundary not after `at`, then newest id, of each key; rows with a tombstone_reason are dropped unless asked for."""
    out = as_of(eras, at, keys)
    return out if tombstones else out.where("tombstone_reason IS NULL")


def run_origin(eras: DataFrame, at: int, keys: list[str], claim: str) -> DataFrame:
    """Of each key the newest *id* among boundaries not after `at`, with origin: the boundary of the least id in the current
    run of equal claims (read backwards by id until the claim differs)."""
    back = Window.partitionBy(*keys).orderBy(F.desc("id"))
    rows = eras.where(F.col("boundary") <= at).withColumn("_newest", F.first(claim).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_breaks", F.sum(F.when(F.col(claim).eqNullSafe(F.col("_newest")), 0).otherwise(1)).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_breaks = 0").groupBy(*keys).agg(F.max("id").alias("id"), F.max_by(claim, "id").alias(claim), F.max_by("boundary", "id").alias("boundary"), F.min_by("boundary", "id").alias("origin"))


def append_scd2(rows: DataFrame, history: DataFrame, keys: list[str], claim: str, now: int, established: str | None = "established_at_ms") -> DataFrame:
    """New history rows (keys, claim, boundary, tombstone_reason) that bring the newest claims to `rows`: the first row of a key
    is dated when it was established (or now), later ones max(now, newest boundary); a key that is gone gets one tombstone."""
    newest = latest_per_key(history, keys, ["boundary", "id"]).select(*keys, F.col(claim).alias("_old"), F.col("boundary").alias("_at"), F.col("tombstone_reason").isNotNull().alias("_dead"), F.lit(True).alias("_had"))
    fresh = rows.select(*keys, F.col(claim).alias("_new"), (F.col(established) if established else F.lit(now)).cast("long").alias("_est"), F.lit(True).alias("_has"))
    met = newest.join(fresh, keys, "full_outer")
    added, gone = F.col("_had").isNull(), F.col("_has").isNull() & ~F.col("_dead")
    changed = F.col("_had") & F.col("_has") & (F.col("_dead") | ~F.col("_old").eqNullSafe(F.col("_new")))
    boundary = F.when(added, F.col("_est")).otherwise(F.greatest(F.lit(now).cast("long"), F.col("_at")))
    return met.where(added | gone | changed).select(*keys, F.col("_new").alias(claim), boundary.alias("boundary"), F.when(gone, F.lit("missing")).alias("tombstone_reason"))


def append_prices(rows: DataFrame, history: DataFrame, keys: list[str], claim: str, now: int) -> DataFrame:
    """Price rows to append: each is compared with the newest id at or before its own boundary, by one as-of read; a key that is dropped gets
    one refusal row (claim null)."""
    upto = Window.partitionBy(*keys).orderBy("boundary", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = history.select(*keys, "boundary", "id", F.max(F.struct("id", F.col(claim).alias("claim"))).over(upto).alias("_seen"))
    asked = rows.groupBy(*keys, F.col("boundary").alias("_b")).agg(F.max(claim).alias("_new"))
    last = as_of_join(asked, told, keys, "_b", ["_seen"])
    add = last.where(F.col("_seen").isNull() | ~F.col("_seen.claim").eqNullSafe(F.col("_new"))).select(*keys, F.col("_new").alias(claim), F.col("_b").alias("boundary"))
    gone = latest_per_key(history, keys, ["id"]).where(F.col(claim).isNotNull()).join(rows.select(*keys).distinct(), keys, "left_anti")
    return add.unionByName(gone.select(*keys, F.lit(None).cast(history.schema[claim].dataType).alias(claim), F.lit(now).cast("long").alias("boundary")))


def catalog_counts(eras: DataFrame, at: int, entity: list[str], covering: DataFrame | None = None) -> DataFrame:
    """One row: entities present at an instant, and those with a rate that is priced or a stated zero; corrected facts left out."""
    keys = [*entity, "fact_key"]
    facts = as_of(eras, at, keys)
    if covering is not None:
        facts = facts.join(covering.select(*keys).distinct(), keys, "left_anti")
    each = facts.groupBy(*entity).agg(F.max((F.col("fact_key") == "existence") & (F.col("value_json") == '"present"')).alias("p"), F.max(F.col("fact_key").startswith("rate.") & F.get_json_object("value_json", "$.state").isin("priced", "stated_zero")).alias("r"))
    return each.agg(F.count_if("p").alias("present"), F.count_if(F.col("p") & F.coalesce("r", F.lit(False))).alias("priced"))


def ledger_bounds(eras: DataFrame) -> DataFrame:
    return eras.agg(F.min("boundary").alias("begins_at"), F.max("boundary").alias("newest"), F.count(F.lit(1)).alias("eras"), F.max("id").alias("latest_id"))


def overdue(rules: DataFrame, now: int, claims: str | None = None) -> DataFrame:
    """Rules past their review date with the whole days since. claims: an array column of sub-claims (subject, review_by_ms, source_ref), each
    of which is due by itself; then the rows are (the rule's columns but claims and review_by_ms, subject, review_by_ms, days_overdue), with
    subject price for the rule itself."""
    from factledger.functions.times import days_overdue

    if claims is not None:
        own = F.struct(F.lit("price").alias("subject"), F.col("review_by_ms").cast("long").alias("review_by_ms"))
        sub = F.transform(F.coalesce(F.col(claims), F.array().cast(rules.schema[claims].dataType)), lambda x: F.struct(x["subject"].alias("subject"), x["review_by_ms"].cast("long").alias("review_by_ms")))
        rest = [c for c in rules.columns if c not in (claims, "review_by_ms")]
        rules = rules.select(*rest, F.explode(F.concat(F.array(own), sub)).alias("_x")).select(*rest, "_x.subject", "_x.review_by_ms")
    return rules.withColumn("days_overdue", days_overdue(F.col("review_by_ms"), F.lit(now))).where("days_overdue IS NOT NULL")


def release_prices(rows: DataFrame, history: DataFrame, keys: list[str], claim: list[str], metadata: list[str], published_at: int, first_release: bool) -> DataFrame:
    """Price rows that a release brings, as they are appended: one whose claim is that of the newest id at publication moves to the time of
    publication (only its metadata is new); on the first release one that also has the same metadata is skipped. Nulls are equal."""
    held = latest_per_key(history.where(F.col("boundary") <= published_at), keys, ["id"]).select(*keys, F.struct(*claim).alias("_c"), F.struct(*metadata).alias("_m"), F.lit(True).alias("_had"))
    met = rows.join(held, keys, "left")
    same, unchanged = F.coalesce(F.col("_had"), F.lit(False)) & F.struct(*claim).eqNullSafe(F.col("_c")), F.struct(*metadata).eqNullSafe(F.col("_m"))
    out = met.where(~(same & unchanged)) if first_release else met
    return out.withColumn("boundary", F.when(same, F.lit(published_at).cast("long")).otherwise(F.col("boundary"))).select(*rows.columns)


def check_invariants(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """Every violation: (violation, row as JSON). A rule that is not true (null included) is violated; unique keys that repeat
    are one violation per key."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    out = df.select(F.explode(found).alias("violation"), F.to_json(F.struct(*df.columns)).alias("row"))
    if unique:
        twice = df.groupBy(*unique).count().where("count > 1").select(F.lit("unique").alias("violation"), F.to_json(F.struct(*unique)).alias("row"))
        out = out.unionByName(twice)
    return out


def era_rules() -> dict[str, Column]:
    """Column rules of an era: a known kind; the window and its reason come with a correction, all of them, and with nothing else; the poll
    before it comes with an observed era and nothing else, and lies before the boundary; a seed names no poll."""
    kind, extent = F.col("kind"), [F.col(c).isNotNull() for c in ("from_ms", "until_ms", "reason")]
    whole, none = extent[0] & extent[1] & extent[2], ~(extent[0] | extent[1] | extent[2])
    return {
        "kind": kind.isin("observed", "asserted", "seed", "corrected"),
        "prior": (kind == "observed") == F.col("prior_ms").isNotNull(),
        "prior_order": F.col("prior_ms").isNull() | (F.col("prior_ms") < F.col("boundary")),
        "window": F.when(kind == "corrected", whole).otherwise(none),
        "window_order": F.col("from_ms").isNull() | (F.col("from_ms") <= F.col("until_ms")),
        "seed_poll": (kind != "seed") | F.col("observation_id").isNull(),
    }


def _stated(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def price_rules() -> dict[str, Column]:
    """Column rules of a price: asserted, a price or a refusal, a price with all its parts, and its provenance."""
    price, refused = F.col("minor_units").isNotNull(), F.col("refusal_reason").isNotNull()
    return {"required": _stated("provider", "tier", "boundary", "established_by", "established_at_ms", "review_by_ms", "source_ref"), "kind": F.col("kind") == "asserted", "price_or_refusal": price != refused, "price_parts": refused | _stated("minor_units", "exponent", "currency", "period")}


def curated_rules() -> dict[str, Column]:
    """Column rules of a curated model: facts with login methods and a review date, or a tombstone without any."""
    told = F.col("facts_json").isNotNull()
    return {"required": _stated("provider", "model", "boundary", "source_ref", "established_at_ms"), "tombstone": told == F.col("tombstone_reason").isNull(), "auth_methods": told == F.col("auth_methods_json").isNotNull(), "review": told == F.col("review_by_ms").isNotNull()}


def override_rules() -> dict[str, Column]:
    """Column rules of a fact override: a value with its reason, quote and review date, or a tombstone that replaces and notes nothing."""
    told = F.col("value_json").isNotNull()
    each = {c: told == F.col(c).isNotNull() for c in ("reason", "quote", "review_by_ms")}
    return {"required": _stated("provider", "model", "fact_key", "boundary", "source_ref", "established_by", "established_at_ms"), "tombstone": told == F.col("tombstone_reason").isNull(), **each, "leftover": told | (F.col("replaces_json").isNull() & F.col("notes").isNull())}


#: The kinds of models that are graded by one number.
GRADE_KINDS = ("transcription", "speech", "image", "video", "search")


def judgment_rules() -> dict[str, Column]:
    """Column rules of a grade: withdrawn with nothing graded, or both numbers of a chat model, or one number and the kind it is for."""
    chat, one, none = _stated("elo", "eq"), F.col("grade").isNotNull(), F.col("elo").isNull() & F.col("eq").isNull()
    gone, live = F.col("withdrawn") == 1, F.col("withdrawn") == 0
    shape = (gone & none & ~one) | (live & chat & ~one & F.col("kind").isNull()) | (live & none & one & F.col("kind").isNotNull())
    return {"required": _stated("model", "graded_by", "reason", "recorded_at_ms"), "withdrawn": F.col("withdrawn").isin(0, 1), "kind": F.col("kind").isNull() | F.col("kind").isin(*GRADE_KINDS), "shape": shape}


def mark_rules() -> dict[str, Column]:
    """Column rules of a decommissioning."""
    return {"required": _stated("model", "marked_by", "reason", "recorded_at_ms"), "decommissioned": F.col("decommissioned").isin(0, 1)}


def lifetime_rules() -> dict[str, Column]:
    """Column rules of a cache lifetime: a claim or, where it is null, a tombstone."""
    return {"required": _stated("provider", "model", "boundary", "recorded_at_ms")}
