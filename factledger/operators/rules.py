"""Curated rule tables: loaded by a declarative spec, with a report of every rejected row.

A spec names the key and the checks. Valid rows survive whatever else is wrong with the table; a rejected row is listed
once with all its reasons. Keys are compared by aggregation and joins, never pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions.claims import listed_efforts
from factledger.functions.keys import is_mode_rate, is_model_key, parse_rate_key

DAY = 86_400_000


@dataclass(frozen=True)
class RuleSpec:
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    checks: dict[str, Column] = field(default_factory=dict)  # reason -> what must hold
    target: tuple[str, ...] = ()  # columns that name another row's key: no row may point at a row that points on
    interval: tuple[str, str] | None = None  # closed windows of one key must not overlap
    first_by: str = "pos"  # the column of positions; of rows that repeat a key, the first valid one stays (see keep). A table without it has no order: none stays
    keep: str = "first"  # or last
    review_days: int | None = None
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)  # reason -> other columns that no two rows may share
    apart: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)  # reason -> columns whose values are no row's other columns
    apart_of: str = "accepted"  # the rows that `apart` looks at: accepted, or valid (those that pass by themselves)
    within: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)  # reason -> table of the context that must have the columns' values
    outside: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)  # reason -> table of the context that must not have them


def load_rules(rows: DataFrame, spec: RuleSpec, context: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(ok, rejects): ok has the columns of rows, rejects also `reasons`. context: the tables that `within` and `outside` name; checks
    against a table that isn't given are left out.

    With positions, rows are taken in their order: one that fails by itself takes no key from another; of the others each is accepted unless an
    accepted row before it has its key (or other unique columns); then accepted rows are judged against one another (targets that point
    on, columns that must be apart). Without, every row is judged against all others, since none comes first."""
    if spec.first_by in rows.columns and not spec.interval:
        return _in_order(rows, spec, context)
    reasons = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"empty_{c}")) for c in (*spec.key, *spec.required)]
    reasons += [F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in spec.checks.items()]
    if spec.review_days is not None:
        reasons.append(F.when(~F.coalesce(F.col("review_by_ms") - F.col("established_at_ms") == spec.review_days * DAY, F.lit(False)), F.lit("review_interval")))
    out = rows
    keys = list(spec.key)
    if spec.interval:
        lo, hi = spec.interval
        reasons.append(F.when(F.col(lo) > F.col(hi), F.lit("backwards_window")))
        order = Window.partitionBy(*keys).orderBy(lo, hi)
        out = out.withColumn("_reach", F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        reasons.append(F.when(F.col("_reach") >= F.col(lo), F.lit("overlapping_window")))
    else:
        out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        reasons.append(F.when(F.col("_n") > 1, F.lit("duplicate_key")))
    if spec.target:
        pointing = rows.select(*[F.col(k).alias(t) for k, t in zip(spec.key, spec.target)], F.lit(True).alias("_chained")).distinct()
        out = out.join(pointing, list(spec.target), "left")
        same = F.lit(True)
        for k, t in zip(spec.key, spec.target):
            same = same & F.col(k).eqNullSafe(F.col(t))
        reasons += [F.when(same, F.lit("self_target")), F.when(F.col("_chained") & ~same, F.lit("chained_target"))]
    for n, (reason, cols) in enumerate(spec.unique.items()):
        out = out.withColumn(f"_u{n}", F.count(F.lit(1)).over(Window.partitionBy(*cols)))
        reasons.append(F.when(F.col(f"_u{n}") > 1, F.lit(reason)))
    for n, (reason, (cols, others)) in enumerate(spec.apart.items()):
        taken = rows.select(*[F.col(b).alias(a) for a, b in zip(cols, others)]).distinct().withColumn(f"_a{n}", F.lit(True))
        out = out.join(taken, list(cols), "left")
        reasons.append(F.when(F.col(f"_a{n}"), F.lit(reason)))
    for n, (reason, (name, cols), wanted) in enumerate([(r, t, True) for r, t in spec.within.items()] + [(r, t, False) for r, t in spec.outside.items()]):
        if context is not None and name in context:
            out = out.join(context[name].select(*cols).distinct().withColumn(f"_c{n}", F.lit(True)), list(cols), "left")
            reasons.append(F.when(F.col(f"_c{n}").isNull() if wanted else F.col(f"_c{n}"), F.lit(reason)))
    out = out.withColumn("reasons", F.array_compact(F.array(*reasons))).select(*rows.columns, "reasons")
    return out.where(F.size("reasons") == 0).select(*rows.columns), out.where(F.size("reasons") > 0)


def _by_itself(rows: DataFrame, spec: RuleSpec, context: dict[str, DataFrame] | None) -> DataFrame:
    """rows with _reasons: what each fails whatever the others say."""
    out = rows
    reasons = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"empty_{c}")) for c in (*spec.key, *spec.required)]
    reasons += [F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in spec.checks.items()]
    if spec.review_days is not None:
        reasons.append(F.when(~F.coalesce(F.col("review_by_ms") - F.col("established_at_ms") == spec.review_days * DAY, F.lit(False)), F.lit("review_interval")))
    if spec.target:
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(spec.key, spec.target)])
        reasons.append(F.when(same, F.lit("self_target")))
    for n, (reason, (name, cols), wanted) in enumerate([(r, t, True) for r, t in spec.within.items()] + [(r, t, False) for r, t in spec.outside.items()]):
        if context is not None and name in context:
            out = out.join(context[name].select(*cols).distinct().withColumn(f"_c{n}", F.lit(True)), list(cols), "left")
            reasons.append(F.when(F.col(f"_c{n}").isNull() if wanted else F.col(f"_c{n}"), F.lit(reason)))
    return out.withColumn("_reasons", F.array_compact(F.array(*reasons))).select(*rows.columns, "_reasons")


def _in_order(rows: DataFrame, spec: RuleSpec, context: dict[str, DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    judged = _by_itself(rows, spec, context).persist()
    valid = judged.where(F.size("_reasons") == 0).select(*rows.columns)
    rejects = [judged.where(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons")]
    order = F.col(spec.first_by) if spec.keep == "first" else F.desc(spec.first_by)
    groups = {"duplicate_key": spec.key} | spec.unique
    leads = lambda cols: F.row_number().over(Window.partitionBy(*cols).orderBy(order)) == 1
    if len(groups) == 1:
        ranked = valid.withColumn("_first", leads(spec.key))
        accepted = ranked.where("_first").drop("_first")
        rejects.append(ranked.where("NOT _first").drop("_first").withColumn("reasons", F.array(F.lit("duplicate_key"))))
    else:
        # each round accepts who comes first in all of its groups and refuses who shares one with them; a chain of rows that hand a key on takes
        # as many rounds as it has links
        left, parts = valid, []
        while not left.isEmpty():
            marked = left
            for n, cols in enumerate(groups.values()):
                marked = marked.withColumn(f"_f{n}", leads(cols))
            new = marked.where(reduce(lambda a, b: a & b, [F.col(f"_f{n}") for n in range(len(groups))])).select(*rows.columns).persist()
            parts.append(new)
            rest = left.join(new.select(spec.first_by).distinct(), spec.first_by, "left_anti")
            for n, cols in enumerate(groups.values()):
                rest = rest.join(new.select(*cols).distinct().withColumn(f"_g{n}", F.lit(True)), list(cols), "left")
            hit = F.array_compact(F.array(*[F.when(F.col(f"_g{n}"), F.lit(reason)) for n, reason in enumerate(groups)]))
            rest = rest.withColumn("reasons", hit).select(*rows.columns, "reasons").persist()
            rejects.append(rest.where(F.size("reasons") > 0))
            left = rest.where(F.size("reasons") == 0).select(*rows.columns)
        accepted = reduce(DataFrame.unionByName, parts) if parts else valid
    out, against = accepted, []
    if spec.target:
        pointing = accepted.select(*[F.col(k).alias(t) for k, t in zip(spec.key, spec.target)]).distinct().withColumn("_chained", F.lit(True))
        out = out.join(pointing, list(spec.target), "left")
        against.append(F.when(F.col("_chained"), F.lit("chained_target")))
    for n, (reason, (cols, others)) in enumerate(spec.apart.items()):
        of = accepted if spec.apart_of == "accepted" else valid
        taken = of.select(*[F.col(b).alias(a) for a, b in zip(cols, others)]).distinct().withColumn(f"_a{n}", F.lit(True))
        out = out.join(taken, list(cols), "left")
        against.append(F.when(F.col(f"_a{n}"), F.lit(reason)))
    out = out.withColumn("reasons", F.array_compact(F.array(*against)) if against else F.array().cast("array<string>")).select(*rows.columns, "reasons")
    rejects.append(out.where(F.size("reasons") > 0))
    return out.where(F.size("reasons") == 0).select(*rows.columns), reduce(DataFrame.unionByName, rejects)


def audit_rules(rules: DataFrame, facts: DataFrame, key: list[str], value: str | None = None) -> DataFrame:
    """Findings against current facts: unused (nothing has the key) and, with `value`, stale (all rows with it say otherwise)."""
    held = facts.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *([F.collect_set(value).alias("_values")] if value else []))
    met = rules.join(held, key, "left")
    finding = F.when(F.col("rows").isNull(), "unused")
    if value:
        finding = finding.when(~F.array_contains("_values", F.col("replaces")), "stale")
    return met.select(*key, finding.alias("finding")).where("finding IS NOT NULL")


def audit_aliases(aliases: DataFrame, facts: DataFrame) -> DataFrame:
    """aliases(provider, model, target_provider, target, wire_ids map) against current facts: recorded (upstream knows the id itself),
    missing_target, and effort_drift with the mapped efforts that the target doesn't list."""
    ids = facts.select("provider", "model").distinct()
    options = facts.where("fact_key = 'capability.reasoning_options'").select(F.col("provider").alias("target_provider"), F.col("model").alias("target"), listed_efforts(F.col("value_json")).alias("_e"))
    m = aliases.join(ids.withColumn("_own", F.lit(True)), ["provider", "model"], "left").join(ids.select(F.col("provider").alias("target_provider"), F.col("model").alias("target"), F.lit(True).alias("_there")), ["target_provider", "target"], "left").join(options, ["target_provider", "target"], "left")
    gone = F.array_sort(F.array_except(F.coalesce(F.map_keys("wire_ids"), F.array().cast("array<string>")), F.coalesce("_e", F.array().cast("array<string>"))))
    found = F.array_compact(F.array(
        F.when(F.col("_own"), F.struct(F.lit("recorded").alias("finding"), F.lit(None).cast("string").alias("detail"))),
        F.when(F.col("_there").isNull(), F.struct(F.lit("missing_target").alias("finding"), F.lit(None).cast("string").alias("detail"))),
        F.when(F.col("_there") & (F.size(gone) > 0), F.struct(F.lit("effort_drift").alias("finding"), F.array_join(gone, ",").alias("detail"))),
    ))
    return m.select("provider", "model", F.explode(found).alias("x")).select("provider", "model", "x.finding", "x.detail")


def audit_twins(twins: DataFrame, facts: DataFrame) -> DataFrame:
    """twins(provider, base, mode, twin) against current facts: missing (base or twin isn't recorded) and colliding (the base states rates of
    that mode itself)."""
    ids = facts.select("provider", F.col("model").alias("_id")).distinct()
    each = twins.select("provider", "base", "mode", F.explode(F.array("base", "twin")).alias("_id")).join(ids, ["provider", "_id"], "left_anti").select("provider", "base", "mode", F.lit("missing").alias("finding"))
    own = facts.where(is_mode_rate(F.col("fact_key"))).select("provider", F.col("model").alias("base"), parse_rate_key(F.col("fact_key"))["mode"].alias("mode")).distinct()
    return each.distinct().unionByName(twins.join(own, ["provider", "base", "mode"], "left_semi").select("provider", "base", "mode", F.lit("colliding").alias("finding")))


def audit_successors(retired: DataFrame, facts: DataFrame, served: DataFrame) -> DataFrame:
    """retired(provider, model, successor) whose successor isn't served, or that upstream has present: invalid_successor, present."""
    here = facts.where("fact_key = 'existence' AND value_json = '\"present\"'").select("provider", "model").distinct()
    bad = retired.where("successor IS NOT NULL").join(served.select("provider", F.col("model").alias("successor")).distinct(), ["provider", "successor"], "left_anti").select("provider", "model", F.lit("invalid_successor").alias("finding"))
    return bad.unionByName(retired.join(here, ["provider", "model"], "left_semi").select("provider", "model", F.lit("present").alias("finding")))


#: Fixed values of the rule tables.
_HTTPS = "^https://"
AUTH_METHODS = ("apikey", "chatgpt", "oauth", "antigravity", "gateway")
TOKEN_CLASSES = ("input", "output", "cache_read", "cache_write", "reasoning", "input_audio", "output_audio")
LIMIT_FACTS = {"limit.images_per_request": "image", "limit.image_bytes": "image", "limit.image_long_edge_px": "image", "limit.document_pages": "pdf", "limit.document_bytes": "pdf"}
LIFETIMES = (("5m", "1h"), ("30m", "12h"), ("in_memory", "24h"), ("24h",))
OVERRIDABLE = ("limit.context", "limit.output", "capability.server_side_fallback", "capability.mid_conversation_system", "capability.reasoning_default", "capability.temperature", "model.status", "rate.output", "rate.output_image", "rate.cached_input_audio")
ADDED_ONLY = ("capability.server_side_fallback", "capability.mid_conversation_system", "capability.reasoning_default", "rate.output_image", "rate.cached_input_audio")


def specs() -> dict[str, RuleSpec]:
    """The kinds of rule tables that the layers take. Contexts: `upstream` and `curated` (provider, model), `lineages` (class), `audio` (provider); for
    complete providers what the accepted wire corrections say, see complete_context."""
    c, by = F.col, ("provider", "model")
    source = {"source_not_https": c("source_ref").rlike(_HTTPS)}
    number = lambda name: c(name).try_cast("decimal(38,18)") > 0
    key, replaces, value = c("fact_key"), c("replaces"), c("value")
    state, boolean = F.get_json_object(value, "$.state"), value.isin("true", "false")
    is_text = value.rlike(r'^".+"$')
    lifetimes = F.lit(False)
    for known in LIFETIMES:
        lifetimes = lifetimes | (c("lifetimes") == F.array(*map(F.lit, known)))
    priced = c("lifetimes")[0].isin("5m", "30m")
    ttls = F.array_sort(F.transform("ratios", lambda r: r["ttl"]))
    modality = F.create_map(*[F.lit(x) for kv in LIMIT_FACTS.items() for x in kv])
    ordered = F.size("conditions") == F.size(F.array_distinct(F.transform("conditions", lambda x: x["above"])))
    stricter = F.forall("conditions", lambda x: (x["value"] > 0) & (x["value"] < value.cast("long")))
    return {
        "aliases": RuleSpec(by, ("target_provider", "target", "basis", "source_ref"), {"output_limit": c("output_limit").isNull() | (c("output_limit") > 0), "default_not_listed": c("default_effort").isNull() | F.map_contains_key("wire_ids", c("default_effort"))}, target=("target_provider", "target")),
        "attachment_limits": RuleSpec(("provider", "fact_key"), ("quote", "notes"), {
            "unknown_fact": key.isin(*LIMIT_FACTS), "modality": F.coalesce(modality[key] == c("modality"), F.lit(False)), "not_positive": number("value"),
            "unknown_kind": c("kind").isin("fixed", "image_count", "context_equals", "context_at_least"), "image_count": (c("kind") != "image_count") | (key == "limit.image_long_edge_px"),
            "threshold": c("kind").isin("fixed", "image_count") | ((c("at") > 0) & (c("other") > 0)), "duplicate_threshold": c("conditions").isNull() | ordered, "not_stricter": c("conditions").isNull() | stricter, **source,
        }, review_days=60),
        "billing_planes": RuleSpec(("provider", "auth_method"), ("source_ref", "established_by"), {
            "unknown_auth_method": c("auth_method").isin(*AUTH_METHODS), "unknown_kind": c("kind").isin("upstream", "quota_proxy"),
            "rates_from_without_quota": c("rates_from").isNull() | ((c("kind") == "quota_proxy") & (F.trim("rates_from") != "")),
            "quota_on_key": (c("kind") != "quota_proxy") | (c("auth_method") != "apikey") | c("rates_from").isNotNull(),
        }),
        "billing_rules": RuleSpec(("provider", "auth_method", "class"), ("action", "source_ref", "established_by"), {
            "unknown_class": c("class").isin(*TOKEN_CLASSES), "unknown_action": c("action").isin("billed_as", "stated_zero", "not_established"), "target": (c("action") == "billed_as") == c("target").isNotNull(),
            "billed_as_itself": c("target").isNull() | (c("target") != c("class")), "empty_model": c("model_ids").isNull() | F.forall("model_ids", lambda m: F.trim(m) != ""),
        }, apart={"billed_as_ruled": (("provider", "auth_method", "target"), ("provider", "auth_method", "class"))}, apart_of="valid"),
        "cache_lifetimes": RuleSpec(by, ("quote", "source_ref"), {
            "unknown_lifetimes": lifetimes, "zero_ratio": F.forall("ratios", lambda r: (r["num"] > 0) & (r["den"] > 0)),
            "missing_multiplier": F.when(priced, ttls == F.array_sort("lifetimes")).otherwise(F.size("ratios") == 0),
        }, review_days=60),
        "canonical_links": RuleSpec(by, ("canonical_id", "quote", "source_ref"), {"not_lab_and_id": c("canonical_id").rlike(r"^[^/\s]+/\S+$")}, review_days=60, within={"missing_upstream": ("upstream", by)}),
        "creators": RuleSpec(("family",), ("creator",), keep="last"),
        "curated_models": RuleSpec((*by, "fact_key"), ("value",), {
            "unknown_key": key.rlike(r"^(rate|limit|capability|model|wire|provider)\."), "endpoint_not_https": ~key.startswith("wire.api") | F.coalesce(F.get_json_object(value, "$.value").rlike(_HTTPS) & (F.get_json_object(value, "$.from") == "curated"), F.lit(False)),
            "invalid_rate": ~key.startswith("rate.") | F.coalesce((state == "stated_zero") | ((state == "priced") & (F.get_json_object(value, "$.units").try_cast("long") > 0) & F.get_json_object(value, "$.unit_provenance").isNotNull()) | ((state == "unpriced") & F.get_json_object(value, "$.reason").isNotNull()), F.lit(False)),
            "price_on_subscription": ~key.startswith("rate.") | (state != "priced") | F.array_contains("auth_methods", "apikey"), "unknown_method": F.size(F.array_except("auth_methods", F.array(*map(F.lit, AUTH_METHODS)))) == 0,
        }),
        "fact_overrides": RuleSpec((*by, "fact_key"), ("value", "reason", "quote", "source_ref"), {
            "not_overridable": key.isin(*OVERRIDABLE), "same_as_replaced": replaces.isNull() | (value != replaces),
            "not_positive": ~key.isin("limit.context", "limit.output") | (number("value") & number("replaces")), "not_boolean": ~key.isin("capability.temperature", "capability.server_side_fallback", "capability.mid_conversation_system") | boolean,
            "addition": ~key.isin(*ADDED_ONLY, "model.status") | replaces.isNull(), "replacement": ~key.isin("capability.temperature", "rate.output") | replaces.isNotNull(),
            "default_effort": (key != "capability.reasoning_default") | value.rlike(r'^\{"type":"effort","value":"[^"]*\S[^"]*"\}$'), "status": (key != "model.status") | (value == '"deprecated"'), "rate": ~key.startswith("rate.") | (state == "priced"),
        }, review_days=60),
        "audio_evidence": RuleSpec(("provider", "class"), ("quote",), {
            "unit": c("quote").rlike(r"(?i)(1\s?M|million|MTok)"), "both_lists": c("include").isNull() | c("exclude").isNull(), "include": c("include").isNull() | ((F.size("include") > 0) & (F.size(F.array_distinct("include")) == F.size("include")) & (c("class") == "input_audio")),
            "tokens_per_second": c("tokens_per_second").isNull() | (c("tokens_per_second") > 0), "overrides": c("overrides").isNull() | F.forall("overrides", lambda o: (o["value"] > 0) & (F.trim(o["model"]) != "")), **source,
        }, review_days=60),
        "login_methods": RuleSpec(by, ("quote", "source_ref"), {"repeated_method": (F.size("methods") > 0) & (F.size(F.array_distinct("methods")) == F.size("methods")), "unknown_method": F.size(F.array_except("methods", F.array(*map(F.lit, AUTH_METHODS)))) == 0}, review_days=60, within={"missing_upstream": ("upstream", by)}, outside={"curated": ("curated", by)}),
        "lineage": RuleSpec(("kind", "key"), ("class", "purpose"), {"unknown_kind": c("kind").isin("model", "family", "lab", "provider"), "model_key": (c("kind") != "model") | c("key").rlike("^[^/]+/.+$"), "plain_key": (c("kind") == "model") | ~c("key").contains("/")}, within={"unknown_class": ("lineages", ("class",))}),
        "plan_prices": RuleSpec(("provider", "tier"), ("source_ref", "established_by"), {
            "price_or_refusal": c("minor_units").isNull() != c("refusal_reason").isNull(), "not_a_price": c("minor_units").isNull() | ((c("minor_units") >= 0) & (c("exponent") >= 0) & c("currency").rlike("^[A-Z]{3}$") & c("period").isNotNull()),
            "claims_without_price": c("refusal_reason").isNull() | F.coalesce(F.size("claims") <= 0, F.lit(True)), "claim_without_source": F.coalesce(F.forall("claims", lambda x: (F.trim(x["source_ref"]) != "") & (x["review_by_ms"] > 0)), F.lit(True)),
        }),
        "speed_twins": RuleSpec(("provider", "base", "mode"), ("twin", "label", "source_ref", "quote"), {"unknown_mode": c("mode").isin("fast", "ultrafast"), "own_twin": c("base") != c("twin"), "api_card": c("api_card").rlike(r"^[^/\s]+/[^/\s]+$")}, review_days=60, unique={"duplicate_twin": ("provider", "twin")}, apart={"twin_is_base": (("provider", "twin"), ("provider", "base"))}),
        "temperature_ranges": RuleSpec(("provider",), ("low", "high"), {"backwards": c("low") <= c("high"), **source}),
        "wire_corrections": RuleSpec((*by, "fact_key"), ("source_ref",), {"value_or_withheld": value.isNull() == c("withheld"), "star_without_quote": (c("model") != "*") | (value.isNotNull() & c("quote").isNotNull()), "text": value.isNull() | is_text}, review_days=60),
        "wire_families": RuleSpec(("npm", "shape"), ("family", "basis"), {"unknown_basis": c("basis").isin("source", "test", "docs")}),
        "held_models": RuleSpec(by, ("reason",), {"held_since": c("held_since_ms") > 0}, within={"no_curated_row": ("curated", by)}),
        "declined_audio": RuleSpec(("provider",), ("source_ref", "quote", "reason"), outside={"declined_and_listed": ("audio", ("provider",))}),
        "complete_providers": RuleSpec(("provider",), ("notes", "source_ref"), {"field": c("fact_key") == "wire.api", "notes_without_commit": c("notes").contains(c("commit"))}, review_days=60, within={"no_routed_model": ("routed", ("provider",))}, outside={"default_beside_list": ("defaulted", ("provider",)), "other_source": ("cited_elsewhere", ("provider",))}),
        "judgments": RuleSpec(("model",), ("graded_by", "reason"), {"not_a_positive_number": c("grade").isNull() | number("grade"), "local_key": ~c("model").startswith("local:"), "key": is_model_key(c("model"))}),
    }


def complete_context(corrections: DataFrame, complete: DataFrame) -> dict[str, DataFrame]:
    """What accepted wire corrections(provider, model, withheld, source_ref) say about complete(provider, source_ref): providers with a routed model,
    with a default for all models, and with a row from another source."""
    met = corrections.join(complete.select("provider", F.col("source_ref").alias("_source")).distinct(), "provider")
    return {"routed": corrections.where("NOT withheld").select("provider"), "defaulted": corrections.where("model = '*'").select("provider"), "cited_elsewhere": met.where(~F.col("source_ref").eqNullSafe(F.col("_source"))).select("provider")}
