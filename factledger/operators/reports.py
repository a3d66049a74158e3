"""Reads and reports over the ledger: labels, keys and instants; counts; prices; judgments and drafts; source status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions.claims import canonical
from factledger.functions.keys import is_rate_relevant
from factledger.operators.asof import as_of, current, last_changed
from factledger.operators.corrections import change_instants, value_at
from factledger.operators.diff import diff_keyed, plan_ingest
from factledger.operators.ledger import failure_history, latest_judgments, ledger_bounds, poll_composition, recent, run_origin, versions


class NoCoverage(LookupError):
    """The ledger can't answer: nothing is recorded for the scope, or not yet at the instant. That isn't an empty answer."""


def select_scope(eras: DataFrame, provider: str | None = None, model: str | None = None, at: int | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """The eras of a scope: a provider, a model of it, or a closed range of providers. A model needs its provider; an unknown provider or
    model, an empty range and an instant before the record are refused by one probe (a limit of one row, or a minimum)."""
    if model is not None and provider is None:
        raise ValueError("a model is selected together with its provider")
    rows = eras if provider is None else eras.where(F.col("provider") == provider)
    rows = rows if model is None else rows.where(F.col("model") == model)
    rows = rows if low is None else rows.where(F.col("provider") >= low)
    rows = rows if high is None else rows.where(F.col("provider") <= high)
    if not (provider is low is high is at is None) and rows.isEmpty():
        raise NoCoverage(f"nothing is recorded for {provider}{'' if model is None else '/' + model}")
    if at is not None and (begins := eras.agg(F.min("boundary")).first()[0]) > at:
        raise NoCoverage(f"the record begins at {begins}")
    return rows


def provider_labels(eras: DataFrame, corrections: DataFrame, at: int, name_key: str = "provider.name") -> DataFrame:
    """(provider, label): the name that the provider's first present model (by id) states at the instant. Where that model's
    existence or its name can't be relied on (corrected or unknown), or the name is empty, there is no row."""
    keys = ["provider", "model", "fact_key"]
    facts = eras.where(F.col("fact_key").isin("existence", name_key))
    present = as_of(facts.where("fact_key = 'existence'"), at, keys).where(F.col("value_json") == '"present"')
    first = present.groupBy("provider").agg(F.min("model").alias("model"))
    read = value_at(facts, corrections, at, keys).where("value_json IS NOT NULL").join(first, ["provider", "model"], "left_semi")
    each = read.groupBy("provider").agg(F.max(F.when(F.col("fact_key") == "existence", F.col("value_json"))).alias("e"), F.max(F.when(F.col("fact_key") == name_key, F.col("value_json"))).alias("v"))
    label = F.get_json_object(F.concat(F.lit('{"v":'), "v", F.lit("}")), "$.v")
    return each.where(F.col("e") == '"present"').select("provider", label.alias("label")).where("label <> ''")


def label_instants(eras: DataFrame, corrections: DataFrame, name_key: str = "provider.name") -> DataFrame:
    """(provider, at): the instants at which a provider's label may change."""
    told = F.col("fact_key").isin("existence", name_key)
    return change_instants(eras.where(told), corrections.where(told), ["provider"])


def all_keys(eras: DataFrame, overrides: DataFrame, curated: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, fact_key): every key ever recorded: in eras, in overrides, in the JSON object `facts_json` of curated rows."""
    inside = curated.select(*entity, F.explode(F.map_keys(F.from_json("facts_json", "map<string,string>"))).alias("fact_key"))
    return eras.select(*entity, "fact_key").unionByName(overrides.select(*entity, "fact_key")).unionByName(inside).distinct()


def providers(eras: DataFrame, col: str = "provider") -> DataFrame:
    return eras.select(col).distinct().orderBy(col)


def present_count(eras: DataFrame, entity: list[str]) -> DataFrame:
    """One row: how many entities the newest existence facts say are present."""
    now = current(eras.where("fact_key = 'existence'"), [*entity, "fact_key"])
    return now.agg(F.count_if(F.col("value_json") == '"present"').alias("present"))


def state_counts(facts: DataFrame, entity: list[str]) -> DataFrame:
    """One row: entities and facts of a state; partial counts per entity first, so no set of entities is gathered."""
    return facts.groupBy(*entity).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("facts"))


def price_list(eras: DataFrame, quotas: DataFrame, tiers: DataFrame, caps: DataFrame, at: int, keys: list[str], claim: str, provider: str | None = None) -> DataFrame:
    """The prices in force, with the origin of their run and the sub-claims (quota_value, service_tiers, concurrency) in force
    of rows that have a price; a refusal row (claim null) keeps none. Sub-claims are histories (keys, value, boundary, id).
    A provider that is asked for and has no row is refused."""
    rows = run_origin(eras if provider is None else eras.where(F.col("provider") == provider), at, keys, claim)
    if provider is not None and rows.isEmpty():
        raise NoCoverage(f"no prices are curated for {provider}")
    priced = F.col(claim).isNotNull()
    for name, sub in (("quota_value", quotas), ("service_tiers", tiers), ("concurrency", caps)):
        now = as_of(sub, at, keys).select(*keys, F.col("value").alias(name))
        rows = rows.join(now, keys, "left").withColumn(name, F.when(priced, F.col(name)))
    return rows


def list_judgments(log: DataFrame, key: str, prefix: str | None = None, of: str | None = None, at: int | None = None) -> DataFrame:
    """The judgments in force, of keys with a prefix if given; or, with `of`, all that was ever said of one key, newest first."""
    if of is not None:
        return log.where(F.col(key) == of).orderBy(F.desc("id"))
    rows = log if prefix is None else log.where(F.col(key).startswith(prefix))
    return latest_judgments(rows, [key], at)


def fact_history(eras: DataFrame, corrections: DataFrame, marked: DataFrame, keys: list[str], at: int) -> DataFrame:
    """Eras with valid_to, the number of corrections of their fact that touch [boundary, valid_to), and the fact's last genuine
    change. Windows and eras are counted, not paired."""
    from factledger.operators.asof import with_intervals
    from factledger.operators.intervals import overlaps

    rows = overlaps(with_intervals(eras, keys), corrections.select(*keys, "from_ms", "until_ms"), keys, "boundary", "valid_to", "corrections")
    return rows.join(last_changed(eras, marked, at, keys), keys, "left")


def source_status(obs: DataFrame, eras: DataFrame, entity: list[str], n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(bounds of the record; entities present; failures of each source; the newest n polls with what they brought, 0 where
    nothing). The composition reads the eras of those polls alone."""
    last = recent(obs, n).withColumnRenamed("id", "observation_id")
    parts = poll_composition(eras.join(last.select("observation_id"), "observation_id", "left_semi"), entity)
    polls = last.join(parts, "observation_id", "left").na.fill(0, ["eras", "arrived", "withdrawn", "facts_changed"])
    return ledger_bounds(eras), present_count(eras, entity), failure_history(obs, ["source"]), polls


def diff_proposals(state: DataFrame, proposals: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The proposals that would change something: keys, current and proposed value; values are compared as claims."""
    met = proposals.select(*keys, F.col(value).alias("proposed")).join(state.select(*keys, F.col(value).alias("current")), keys, "left")
    return met.where(~canonical(F.col("current")).eqNullSafe(canonical(F.col("proposed")))).select(*keys, "current", "proposed")


def rule_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How many rows of a rule document were added, removed and changed: (change, rows)."""
    return diff_keyed(old, new, keys, value).groupBy("change").agg(F.count(F.lit(1)).alias("rows"))


def curation_rows(judgments: DataFrame, documents: DataFrame, at: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The curation set as rows: (kind, key, value) in order over ranges, to be written by kind, and (kind, approved_at_ms), the newest
    approval time of each. Inputs as for export_curation; nothing is collected, so a kind may have any number of rows."""
    rows = _curation(judgments, documents, at)
    return rows.select("kind", "key", "value").orderBy("kind", "key", "value"), rows.groupBy("kind").agg(F.max("approved").alias("approved_at_ms"))


def export_curation(judgments: DataFrame, documents: DataFrame, at: int | None = None) -> DataFrame:
    """The curation set, one JSON per kind: judgments(kind, key, value, id, withdrawn, recorded_at_ms) in force and
    documents(kind, key, value, boundary, id), with the newest approval time of the kind. All entries of a kind are held in one
    row: for kinds that don't fit one, see curation_rows."""
    pair = F.struct("key", "value")
    return _curation(judgments, documents, at).groupBy("kind").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair)))).alias("entries"), F.max("approved").alias("approved_at_ms"))


def _curation(judgments: DataFrame, documents: DataFrame, at: int | None) -> DataFrame:
    j = latest_judgments(judgments, ["kind", "key"], at).select("kind", "key", "value", F.col("recorded_at_ms").alias("approved"))
    d = (current(documents, ["kind", "key"]) if at is None else as_of(documents, at, ["kind", "key"])).select("kind", "key", "value", F.col("boundary").alias("approved"))
    return j.unionByName(d)


def release_rows(before: DataFrame, after: DataFrame, ops: DataFrame, entity: list[str], release: int, published_at: int) -> DataFrame:
    """The eras that a release adds to the ledger: the entities its ops touch, compared before and after."""
    plan = plan_ingest(before, after, entity, touched=ops.select(*entity))
    return plan.withColumn("boundary", F.lit(published_at).cast("long")).withColumn("observation_id", F.lit(release).cast("long"))


def version_cursors(batches: DataFrame, changed: DataFrame, start: int = 0) -> DataFrame:
    """batches(id, now_ms), changed(batch id, fact_key) -> id, version and rates_version of each batch that changed anything; rates_version is
    the version of the newest batch so far in which a fact that drives rates changed. One row per write batch."""
    from pyspark.sql import Window

    moved = changed.groupBy("id").agg(F.max(is_rate_relevant(F.col("fact_key"))).alias("_rates"))
    rows = versions(batches.join(moved, "id"), start)
    order = Window.partitionBy().orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("id", "version", F.max(F.when(F.col("_rates"), F.col("version"))).over(order).alias("rates_version"))
