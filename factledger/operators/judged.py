"""Facts that rules and judgments add to entities: limits by condition, audio conversions, grades, efforts and workloads.

Rules are gathered per provider, judgments per key, so each layer is one join and one expression over what an entity says.
What is added is a list of entries (key, value, at), which a view puts into the entity's facts and a report explodes into rows.
Rule tables carry no broadcast hint; judgments, which may be as many as entities, are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions.claims import lists, listed_efforts, put_all, quoted, restricted_options, text_of
from factledger.operators.layers import ID, KEY, by_entity, fact_map, has

#: The keys of judged facts, as served.
GRADED_EFFORT, ELO_EFFORT, EQ_EFFORT = "quality.graded_effort", "quality.elo.effort.", "quality.eq.effort."
ELO, EQ, GRADE, DECOMMISSIONED = "quality.elo", "quality.eq", "quality.grade.", "quality.decommissioned"
AUDIO_RATE, AUDIO_TOKENS = "rate.input_audio", "limit.audio_tokens_per_second"
ENTRY = "array<struct<key: string, value: string, at: bigint>>"


def _entry(key: Column, value: Column, at: Column | None = None) -> Column:
    """An entry, or null where there is no value."""
    e = F.struct(key.alias("key"), value.alias("value"), (F.lit(None) if at is None else at).cast("long").alias("at"))
    return F.when(value.isNotNull(), e)


def _rows(met: DataFrame, entries: Column, *others: str) -> DataFrame:
    x = met.select(*ID, F.explode(entries).alias("x"))
    return x.select(*ID, F.col("x.key").alias("fact_key"), F.col("x.value").alias("value_json"), *[F.col("x.at").alias(o) for o in others])


def _as_facts(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(x["key"], x["value"])))


def limit_table(limits: DataFrame) -> DataFrame:
    """limits(provider, fact_key, modality, kind, value, at, other, conditions), one row per provider."""
    return limits.groupBy("provider").agg(F.collect_list(F.struct("fact_key", "modality", "kind", "value", "at", "other", "conditions")).alias("limits"))


def limit_entries(modalities: Column, context: Column, limits: Column) -> Column:
    """Entries for an entity that accepts the modality. kind fixed and image_count give value; context_equals gives value where the
    context is `at`, else other; context_at_least gives value from `at` on, else other; both give nothing without a context
    (null or 0). Of image_count each entry of conditions (above, value) is a fact `<fact_key>.above_images.<above>`."""
    context = F.when(context > 0, context)

    def of(x: Column) -> Column:
        reached = F.when(x["kind"] == "context_equals", context == x["at"]).when(x["kind"] == "context_at_least", context >= x["at"])
        value = F.when(x["kind"].isin("fixed", "image_count") | reached, x["value"]).when(~reached, x["other"])
        more = F.when((x["kind"] == "image_count") & x["conditions"].isNotNull(), F.transform(x["conditions"], lambda c: _entry(F.concat(x["fact_key"], F.lit(".above_images."), c["above"].cast("string")), c["value"].cast("string"))))
        return F.concat(F.array(_entry(x["fact_key"], value.cast("string"))), F.coalesce(more, F.array().cast(ENTRY)))

    mine = F.filter(limits, lambda x: F.array_contains(modalities, x["modality"]))
    return F.coalesce(F.array_compact(F.flatten(F.transform(mine, of))), F.array().cast(ENTRY))


def limit_facts(entities: DataFrame, limits: DataFrame) -> DataFrame:
    """entities(provider, model, modalities, context): the limits as fact rows."""
    return _rows(entities.join(limit_table(limits), "provider"), limit_entries(F.col("modalities"), F.col("context"), F.col("limits")))


def apply_limits(e: DataFrame, limits: DataFrame) -> DataFrame:
    """The limits among the facts of entities of their own; an alias is served elsewhere, whose limits nobody states."""
    m = e.join(limit_table(limits), "provider", "left")
    found = limit_entries(F.from_json(fact_map()["capability.input_modalities"], "array<string>"), fact_map()["limit.context"].try_cast("long"), F.col("limits"))
    if "alias_of" in e.columns:
        found = F.when(F.col("alias_of").isNull(), found).otherwise(F.array().cast(ENTRY))
    return m.withColumn("facts", put_all(fact_map(), _as_facts(found))).drop("limits")


def audio_rates(facts: DataFrame, defaults: DataFrame, overrides: DataFrame, aliases: DataFrame | None = None, rate: str = AUDIO_RATE, key: str = AUDIO_TOKENS) -> DataFrame:
    """The fact `key` for entities that have an audio rate and don't state it: the override of their model, else the default
    of their provider. defaults(provider, value), overrides(provider, model, value); an alias (provider, model,
    target_provider, target) takes what holds for its target. A provider without a default gets nothing."""
    need = facts.where(F.col("fact_key") == rate).select(*ID).distinct().join(facts.where(F.col("fact_key") == key).select(*ID), ID, "left_anti")
    if aliases is None:
        source = need.select(*ID, F.col("provider").alias("_p"), F.col("model").alias("_m"))
    else:
        source = need.join(aliases.select(*ID, "target_provider", "target"), ID, "left").select(*ID, F.coalesce("target_provider", "provider").alias("_p"), F.coalesce("target", "model").alias("_m"))
    met = _audio(source, defaults, overrides)
    return met.where("_audio IS NOT NULL").select(*ID, F.lit(key).alias("fact_key"), F.col("_audio").alias("value_json"))


def _audio(e: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """e with _audio, the conversion that holds for (_p, _m)."""
    met = e.join(defaults.select(F.col("provider").alias("_p"), F.col("value").alias("_all")), "_p", "left")
    met = met.join(overrides.select(F.col("provider").alias("_p"), F.col("model").alias("_m"), F.col("value").alias("_own")), ["_p", "_m"], "left")
    return met.withColumn("_audio", F.when(F.col("_all").isNotNull(), F.coalesce("_own", "_all").cast("string"))).drop("_p", "_m", "_all", "_own")


def apply_audio(e: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """The same among the facts of folded entities; an alias borrows its target's."""
    of = F.col("alias_of") if "alias_of" in e.columns else F.lit(None).cast("struct<provider:string,model:string>")
    m = _audio(e.withColumn("_p", F.coalesce(of["provider"], "provider")).withColumn("_m", F.coalesce(of["model"], "model")), defaults, overrides)
    need = has(AUDIO_RATE) & ~has(AUDIO_TOKENS) & F.col("_audio").isNotNull()
    return m.withColumn("facts", F.when(need, put_all(fact_map(), F.create_map(F.lit(AUDIO_TOKENS), F.col("_audio")))).otherwise(fact_map())).select(*e.columns)


def restrict_efforts(facts: DataFrame, aliases: DataFrame, key: str = "capability.reasoning_options") -> DataFrame:
    """aliases(provider, model, wire_ids map): an alias that maps efforts keeps of its option lists the mapped values only, in
    their order, and says route.reasoning_wire_ids. An alias without a map (null or empty) stays as it is; so do
    entries of another type."""
    a = aliases.where(F.size("wire_ids") > 0).select(*ID, "wire_ids")
    met = facts.join(a, ID, "left")
    value = F.when((F.col("fact_key") == key) & F.col("wire_ids").isNotNull(), restricted_options(F.col("value_json"), F.col("wire_ids"))).otherwise(F.col("value_json"))
    says = a.join(facts.select(*ID).distinct(), ID, "left_semi").select(*ID, F.lit("route.reasoning_wire_ids").alias("fact_key"), F.to_json("wire_ids").alias("value_json"))
    return met.select(*KEY, value.alias("value_json")).join(says.select(*KEY), KEY, "left_anti").unionByName(says)


def judgments(grades: DataFrame | None = None, marks: DataFrame | None = None, graded: DataFrame | None = None, derived: DataFrame | None = None, workloads: DataFrame | None = None) -> DataFrame:
    """All judgments in force, one row per key: grades(key, kind, elo, eq, grade, recorded_at_ms), marks(key, recorded_at_ms), graded(key,
    effort, recorded_at_ms), derived(key, effort, elo, eq, recorded_at_ms), workloads(key, workload, effort_default,
    effort_minimum, excluded, recorded_at_ms). Keys of local models are not served. Tables that are None are empty."""
    shapes = {"grades": "kind string, elo string, eq string, grade string, recorded_at_ms bigint", "marks": "recorded_at_ms bigint", "graded": "effort string, recorded_at_ms bigint", "derived": "effort string, elo string, eq string, recorded_at_ms bigint", "workloads": "workload string, effort_default string, effort_minimum string, excluded boolean, recorded_at_ms bigint"}
    given, parts = {"grades": grades, "marks": marks, "graded": graded, "derived": derived, "workloads": workloads}, []
    for name, table in given.items():
        if table is not None:
            cells = [(F.struct(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in shapes[n].split(", ")]) if n == name else F.lit(None).cast(f"struct<{shapes[n].replace(' ', ': ').replace(',:', ',')}>")).alias(n) for n in shapes]
            parts.append(table.where(~F.col("key").startswith("local:")).select("key", *cells))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg(*[F.collect_list(n).alias(n) for n in shapes])


def judged_entries(efforts: Column, kind: Column) -> Column:
    """Entries with the instant of the judgment. A chat grade (kind null or chat) holds unless the entity says another type; other grades
    name their kind. Graded and derived efforts count only where the entity lists them, a derived grade not for the effort that was
    measured; an excluded workload stands alone, a default must be listed, a minimum need not be."""
    at = lambda x: x["recorded_at_ms"]
    not_chat = F.coalesce(kind != "chat", F.lit(False))
    chat = lambda x: x["grade"].isNull() & ~not_chat
    g = F.transform("grades", lambda x: F.array(
        _entry(F.lit(ELO), F.when(chat(x), x["elo"]), at(x)), _entry(F.lit(EQ), F.when(chat(x), x["eq"]), at(x)),
        _entry(F.concat(F.lit(GRADE), x["kind"]), F.when(x["kind"].isNotNull(), x["grade"]), at(x))))
    m = F.transform("marks", lambda x: F.array(_entry(F.lit(DECOMMISSIONED), F.lit("true"), at(x))))
    measured = F.transform("graded", lambda x: x["effort"])
    own = F.transform("graded", lambda x: F.array(_entry(F.lit(GRADED_EFFORT), F.when(lists(efforts, x["effort"]), quoted(x["effort"])), at(x))))
    told = lambda x: lists(efforts, x["effort"]) & ~F.array_contains(measured, x["effort"])
    d = F.transform("derived", lambda x: F.array(_entry(F.concat(F.lit(ELO_EFFORT), x["effort"]), F.when(told(x), x["elo"]), at(x)), _entry(F.concat(F.lit(EQ_EFFORT), x["effort"]), F.when(told(x), x["eq"]), at(x))))
    said = lambda x, field: F.concat(F.lit("workload."), x["workload"], F.lit(f".{field}"))
    out = lambda x: F.coalesce(x["excluded"], F.lit(False))
    w = F.transform("workloads", lambda x: F.array(
        _entry(said(x, "excluded"), F.when(out(x), F.lit("true")), at(x)),
        _entry(said(x, "effort_default"), F.when(~out(x) & lists(efforts, x["effort_default"]), quoted(x["effort_default"])), at(x)),
        _entry(said(x, "effort_minimum"), F.when(~out(x), quoted(x["effort_minimum"])), at(x))))
    return F.array_compact(F.flatten(F.concat(g, m, own, d, w)))


def _judged_key(canonical: Column, is_alias: Column) -> Column:
    """Judgments are those of the canonical id, else of the own id; an alias without a canonical id gets none."""
    return F.coalesce(canonical, F.when(~is_alias, F.concat_ws("/", *ID)))


def effort_facts(entities: DataFrame, graded: DataFrame, derived: DataFrame, workloads: DataFrame) -> DataFrame:
    """entities(provider, model, canonical_id, is_alias, efforts array): effort and workload facts with recorded_at_ms, whose greatest
    value is the newest judgment time of a view."""
    e = entities.select(*ID, "efforts", _judged_key(F.col("canonical_id"), F.col("is_alias")).alias("key"))
    return _rows(e.join(judgments(None, None, graded, derived, workloads), "key"), judged_entries(F.col("efforts"), F.lit(None).cast("string")), "recorded_at_ms")


def apply_judgments(e: DataFrame, told: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """What judgments(...) say among the facts of folded entities, keys of the asked prefixes only. Adds judged_at_ms, the newest of
    the judgments that an entity shows (null: none)."""
    from factledger.functions.keys import has_prefix

    is_alias = F.col("alias_of").isNotNull() if "alias_of" in e.columns else F.lit(False)
    m = e.withColumn("key", _judged_key(text_of(fact_map()["model.canonical_id"]), is_alias)).join(by_entity(told), "key", "left")
    entries = judged_entries(listed_efforts(fact_map()["capability.reasoning_options"]), text_of(fact_map()["model.type"]))
    found = F.coalesce(F.filter(entries, lambda x: has_prefix(x["key"], prefixes)), F.array().cast(ENTRY))
    m = m.withColumn("_found", found).withColumn("facts", put_all(fact_map(), _as_facts(F.col("_found"))))
    return m.select(*e.columns, F.array_max(F.transform("_found", lambda x: x["at"])).alias("judged_at_ms"))


#: Kinds of grades beside chat with the fact and the modality that a row must state, and the workloads.
EVIDENCE = {"transcription": ("capability.input_modalities", "audio"), "speech": ("capability.output_modalities", "audio"), "image": ("capability.output_modalities", "image"), "video": ("capability.output_modalities", "video")}
WORKLOADS = ("reason", "code", "synthesize", "lookup", "quick")


def reached(served: DataFrame) -> DataFrame:
    """One row per judgment key that a served entity answers to (its canonical id, else its own; an alias without one answers to none): what
    its entities say together: kinds they give evidence of, whether one is a chat model, and the efforts they list."""
    is_alias = F.col("alias_of").isNotNull() if "alias_of" in served.columns else F.lit(False)
    f, kind = fact_map(), text_of(fact_map()["model.type"])
    says = [F.when(F.array_contains(F.from_json(f[fact], "array<string>"), m), F.lit(k)) for k, (fact, m) in EVIDENCE.items()] + [F.when(kind == "search", F.lit("search"))]
    e = served.select(_judged_key(text_of(f["model.canonical_id"]), is_alias).alias("key"), F.array_compact(F.array(*says)).alias("kinds"), (kind.isNull() | (kind == "chat")).alias("chat"), listed_efforts(f["capability.reasoning_options"]).alias("efforts"))
    merged = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))  # noqa: E731  a few kinds and efforts
    return e.where("key IS NOT NULL").groupBy("key").agg(merged("kinds").alias("kinds"), F.max("chat").alias("chat"), merged("efforts").alias("listed"))


def check_grades(requests: DataFrame, served: DataFrame) -> DataFrame:
    """requests(key, kind, elo, eq, grade, graded_effort, withdrawn, reason) with `refusals`, every reason against a request: empty_reason,
    unknown_kind, dimensions (elo and eq without a kind, or a grade with one; a withdrawal has none), not_positive, effort_without_chat,
    local_chat (a local key takes grades of a kind only), unknown_key, no_evidence (no row of the key states what the kind needs),
    not_chat, effort_not_listed."""
    m = requests.join(reached(served), "key", "left")
    c, none = F.col, lambda x: F.col(x).isNull()
    gone, local = F.coalesce(c("withdrawn") == 1, F.lit(False)), c("key").startswith("local:")
    chat = c("elo").isNotNull() & c("eq").isNotNull() & none("grade") & none("kind")
    media = c("grade").isNotNull() & c("kind").isNotNull() & none("elo") & none("eq")
    empty = none("elo") & none("eq") & none("grade")
    wrong = lambda x: F.coalesce(F.col(x).try_cast("decimal(38,18)") <= 0, F.col(x).isNotNull())
    known = c("chat").isNotNull() | local
    return m.select(*requests.columns, F.array_compact(F.array(
        F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "empty_reason"),
        F.when(~c("kind").isin(*EVIDENCE, "search"), "unknown_kind"),
        F.when(~F.when(gone, empty).otherwise(chat | media), "dimensions"),
        F.when(wrong("elo") | wrong("eq") | wrong("grade"), "not_positive"),
        F.when(c("graded_effort").isNotNull() & ~chat, "effort_without_chat"),
        F.when(local & (none("kind") | c("elo").isNotNull()), "local_chat"),
        F.when(~known, "unknown_key"),
        F.when(known & ~local & ~gone & c("kind").isin(*EVIDENCE, "search") & ~F.array_contains("kinds", c("kind")), "no_evidence"),
        F.when(chat & c("chat").isNotNull() & ~c("chat"), "not_chat"),
        F.when(c("graded_effort").isNotNull() & c("listed").isNotNull() & ~F.array_contains("listed", c("graded_effort")), "effort_not_listed"),
    )).alias("refusals"))


def check_workloads(requests: DataFrame, served: DataFrame) -> DataFrame:
    """requests(key, workload, effort_default, effort_minimum, excluded, withdrawn, reason) with `refusals`: empty_reason, unknown_workload,
    one_of (a default, perhaps with a minimum; or an exclusion; or a withdrawal), unknown_key, default_not_listed, minimum_not_listed."""
    m = requests.join(reached(served), "key", "left")
    out, gone = F.coalesce("excluded", F.lit(False)), F.coalesce(F.col("withdrawn") == 1, F.lit(False))
    efforts = F.col("effort_default").isNotNull() | F.col("effort_minimum").isNotNull()
    listed = lambda x: F.col(x).isNull() | F.col("listed").isNull() | F.array_contains("listed", F.col(x))
    one = F.when(out | gone, ~efforts & ~(out & gone)).otherwise(F.col("effort_default").isNotNull())
    return m.select(*requests.columns, F.array_compact(F.array(
        F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "empty_reason"), F.when(~F.coalesce(F.col("workload").isin(*WORKLOADS), F.lit(False)), "unknown_workload"), F.when(~one, "one_of"), F.when(F.col("chat").isNull(), "unknown_key"),
        F.when(~listed("effort_default"), "default_not_listed"), F.when(~listed("effort_minimum"), "minimum_not_listed"),
    )).alias("refusals"))
