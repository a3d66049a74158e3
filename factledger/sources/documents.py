"""Nested documents: provider -> model -> attributes and prices, as facts; and facts as nested documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.functions.claims import quoted
from factledger.functions.keys import is_mode_name
from factledger.functions.money import encode_rate, to_minor_units

MODEL = """STRUCT<id STRING, name STRING, family STRING, canonical_model_id STRING, status STRING, type STRING, release_date STRING, last_updated STRING,
 knowledge STRING, open_weights BOOLEAN, reasoning BOOLEAN, reasoning_options STRING, structured_output BOOLEAN, temperature BOOLEAN, tool_call BOOLEAN, attachment BOOLEAN,
 limit STRUCT<context BIGINT, output BIGINT, input BIGINT>, modalities STRUCT<input ARRAY<STRING>, output ARRAY<STRING>>, cost STRING,
 provider STRUCT<npm STRING, api STRING, shape STRING>, experimental STRUCT<modes MAP<STRING, STRING>>>"""
DOCUMENT = f"MAP<STRING, STRUCT<name STRING, doc STRING, api STRING, npm STRING, env ARRAY<STRING>, models MAP<STRING, {MODEL}>>>"
#: The rate classes that are priced per million tokens, and those that are only where there is evidence.
CLASSES, AUDIO = ("input", "output", "cache_read", "cache_write", "reasoning"), ("input_audio", "output_audio")
#: Facts of every model, null where unstated (field of the document: key); and those only where stated.
ALWAYS = {
    "family": "model.family", "open_weights": "model.open_weights", "canonical_model_id": "model.canonical_id", "status": "model.status", "limit.context": "limit.context", "limit.output": "limit.output", "reasoning": "capability.reasoning",
    "reasoning_options": "capability.reasoning_options", "tool_call": "capability.tool_call", "attachment": "capability.attachment", "modalities.input": "capability.input_modalities", "modalities.output": "capability.output_modalities",
}
SPARSE = {"name": "model.name", "type": "model.type", "structured_output": "capability.structured_output", "temperature": "capability.temperature"}


#: What the error of a document that can't be read says.
REFUSED = "the document is not a map of providers"


def refused(error: Exception) -> bool:
    """Whether an error comes from the document, not from the system that reads it."""
    return f"{REFUSED}" in str(error) and "USER_RAISED_EXCEPTION" in str(error)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per model of each file, see parse_documents."""
    return parse_documents(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def parse_documents(raw: DataFrame) -> DataFrame:
    """raw(file, value) -> one row per model: file, provider, provider columns, model and its struct. A document that isn't a map of providers stops
    the job with an error that refused() knows."""
    doc = F.when(F.col("value").rlike(r"^\s*\{"), F.from_json("value", DOCUMENT))
    providers = raw.select("file", F.explode(F.coalesce(doc, F.raise_error(F.lit(REFUSED)).cast(DOCUMENT))).alias("provider", "p"))
    return providers.select("file", "provider", F.col("p.name").alias("provider_name"), F.col("p.npm").alias("provider_npm"), F.col("p.api").alias("provider_api"), F.col("p.doc").alias("provider_doc"), F.col("p.env").alias("provider_env"), F.explode("p.models").alias("model", "m"))


def normalise_models(models: DataFrame) -> DataFrame:
    """A zero limit and an empty name count as unstated; npm and api come from the model or else its provider, shape from the model
    alone, each with where it is from in `npm_from`, `api_from` and `shape_from`."""
    m = models.withColumn("m", F.col("m").withField("name", F.nullif(F.trim("m.name"), F.lit("")))).withColumn("provider_name", F.nullif(F.trim("provider_name"), F.lit("")))
    for k in ("context", "output", "input"):
        m = m.withColumn("m", F.col("m").withField(f"limit.{k}", F.nullif(F.col(f"m.limit.{k}"), F.lit(0))))
    for k in ("npm", "api", "shape"):
        own, given = F.col(f"m.provider.{k}"), F.col(f"provider_{k}") if k != "shape" else F.lit(None).cast("string")
        m = m.withColumn(k, F.coalesce(own, given)).withColumn(f"{k}_from", F.when(own.isNotNull(), "model").when(given.isNotNull(), "provider"))
    return m


_FOUND = "array<struct<fact_key: string, text: string, finding: string>>"


def _found(key, text, finding=None):
    return F.struct(key.alias("fact_key"), text.cast("string").alias("text"), (F.lit(None) if finding is None else finding).cast("string").alias("finding"))


def rates(models: DataFrame, audio: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rate facts, findings) from the open cost block and the modes; one generator, no shuffle but for the join with audio.

    Plain classes are read at the top and in tiers[] (a context size each; one without a size says nothing). Audio classes count only where
    audio(provider, class) says that the provider prices them by token, and not where a tier or the older block prices them
    too; they and any other key are findings, since the unit is not known. context_over_200k must repeat a tier; if not, and
    where a tier has no type or an unknown one, or a number is negative, no number or rounds to zero, the whole card is
    refused with a finding. A mode is refused alone: a name that can't be a key, a cost that isn't an object, a key
    without a unit, a bad number; a mode without a cost says nothing.
    """
    m = models
    if audio is not None:
        told = audio.groupBy(F.col("provider")).agg(F.collect_set("class").alias("_audio"))
        m = m.join(told, "provider", "left")
    proven = F.coalesce(F.col("_audio"), F.array().cast("array<string>")) if audio is not None else F.array().cast("array<string>")
    top = "map<string,string>"
    m = m.select("provider", "model", proven.alias("proven"), F.from_json("m.cost", top).alias("cost"), F.coalesce(F.col("m.experimental.modes"), F.create_map().cast(top)).alias("modes"))
    m = m.withColumn("tiers", F.coalesce(F.from_json(F.col("cost")["tiers"], f"array<{top}>"), F.array().cast(f"array<{top}>"))).withColumn("older", F.from_json(F.col("cost")["context_over_200k"], top))
    scalars = lambda t: F.map_filter(t, lambda k, _: k != "tier")
    kind = lambda t: F.get_json_object(t["tier"], "$.type")
    text = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    bad_tier = F.transform(F.filter("tiers", lambda t: F.coalesce(kind(t) != "context", F.lit(True))), lambda t: _found(F.lit("rate.tiers"), kind(t), F.when(kind(t).isNull(), "tier_without_type").otherwise("unknown_tier_type")))
    orphan = F.when(F.col("older").isNotNull() & ~F.exists("tiers", lambda t: text(scalars(t)) == text(F.col("older"))), F.array(_found(F.lit("rate.context_over_200k"), text(F.col("older")), F.lit("orphaned_older_tier"))))
    base = F.map_filter(F.coalesce("cost", F.create_map().cast(top)), lambda k, _: ~k.isin("tiers", "context_over_200k"))
    twice = lambda k: F.exists("tiers", lambda t: F.map_contains_key(t, k)) | F.coalesce(F.map_contains_key("older", k), F.lit(False))
    counted = lambda k: k.isin(*CLASSES) | (k.isin(*AUDIO) & F.array_contains("proven", k) & ~twice(k))
    plain = F.transform(F.map_entries(base), lambda x: _found(F.concat(F.lit("rate."), x["key"]), x["value"], F.when(~counted(x["key"]), "unknown_unit")))
    size = lambda t: F.get_json_object(t["tier"], "$.size")
    tiered = F.flatten(F.transform(F.filter("tiers", lambda t: size(t).isNotNull()), lambda t: F.transform(F.filter(F.map_entries(t), lambda x: x["key"].isin(*CLASSES)), lambda x: _found(F.concat(F.lit("rate."), x["key"], F.lit(".above_context."), size(t)), x["value"]))))
    one = F.concat(bad_tier, F.coalesce(orphan, F.array().cast(_FOUND)), plain, tiered)
    # the card itself (mode null) and each of its modes, in one pass over the document
    card = F.struct(F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("raw"))
    each = F.concat(F.array(card), F.transform(F.map_entries("modes"), lambda x: F.struct(x["key"].alias("mode"), x["value"].alias("raw"))))
    m = m.withColumn("_card", F.explode(each)).withColumn("mode", F.col("_card.mode")).withColumn("raw", F.col("_card.raw"))
    cost = F.get_json_object("raw", "$.cost")
    entries = F.map_entries(F.from_json(cost, top))
    in_mode = F.transform(entries, lambda x: _found(F.concat(F.lit("rate."), x["key"], F.lit(".mode."), F.col("mode")), x["value"], F.when(~x["key"].isin(*CLASSES), "unknown_unit")))
    refused = F.when(~F.col("raw").rlike(r"^\s*\{"), "not_an_object").when(cost.isNull(), None).when(~is_mode_name(F.col("mode")), "bad_mode_name").when(~cost.rlike(r"^\s*\{"), "cost_is_no_object")
    of_mode = F.when(refused.isNotNull(), F.array(_found(F.lit("rate.mode"), F.col("raw"), refused))).otherwise(F.coalesce(in_mode, F.array().cast(_FOUND)))

    def judged(c):
        """Findings of a card, with those of its numbers."""
        n = F.transform(c, lambda x: F.struct(x["fact_key"].alias("fact_key"), to_minor_units(x["text"]).alias("n"), x["finding"].alias("finding")))
        return F.transform(n, lambda x: F.struct(x["fact_key"].alias("fact_key"), x["n"]["units"].alias("units"), F.coalesce(x["finding"], x["n"]["error"]).alias("finding")))

    cards = m.select("provider", "model", "mode", F.when(F.col("mode").isNull(), one).otherwise(of_mode).alias("found"))
    cards = cards.withColumn("found", judged(F.col("found")))
    own = lambda x: x["finding"].isNotNull() & ((x["finding"] != "unknown_unit") | F.col("mode").isNotNull())  # noqa: E731  an unknown unit of the base refuses that key alone
    cards = cards.withColumn("refused", F.exists("found", own))
    rows = cards.select("provider", "model", "refused", F.explode("found").alias("x")).select("provider", "model", "refused", "x.fact_key", "x.units", "x.finding")
    ok = rows.where("NOT refused AND finding IS NULL").select("provider", "model", "fact_key", encode_rate(F.col("units")).alias("value_json"))
    return ok, rows.where("finding IS NOT NULL").select("provider", "model", "fact_key", "finding")


def to_facts(models: DataFrame, audio: DataFrame | None = None) -> DataFrame:
    """Normalised models -> facts (provider, model, fact_key, value_json), rates included. Lists of modalities are sorted; reasoning options keep
    their order."""
    def text(name: str):
        c = F.col(f"m.{name}")
        if name.startswith("modalities"):
            return F.to_json(F.array_sort(c))
        kind = models.select(c.alias("x")).schema["x"].dataType.typeName()
        return quoted(c) if kind == "string" and name != "reasoning_options" else c.cast("string")

    entry = lambda key, value, keep: F.struct(F.lit(key).alias("fact_key"), F.coalesce(value, F.lit("null")).alias("value_json"), keep.alias("keep"))
    entries = [entry(k, text(f), F.lit(True)) for f, k in ALWAYS.items()] + [entry(k, text(f), F.col(f"m.{f}").isNotNull()) for f, k in SPARSE.items()]
    entries.append(entry("provider.name", quoted(F.col("provider_name")), F.col("provider_name").isNotNull()))
    for k in ("npm", "api", "shape"):
        entries.append(entry(f"wire.{k}", F.to_json(F.struct(F.col(k).alias("value"), F.col(f"{k}_from").alias("from"))), F.col(k).isNotNull()))
    entries.append(entry("existence", F.lit('"present"'), F.lit(True)))
    plain = models.select("provider", "model", F.explode(F.filter(F.array(*entries), lambda x: x["keep"])).alias("f")).select("provider", "model", "f.fact_key", "f.value_json")
    return plain.unionByName(rates(models, audio)[0])


def export_snapshot(facts: DataFrame) -> DataFrame:
    """One nested JSON per provider: {"facts": {...}, "models": {model: {...}}}; provider facts have a null model. A group is
    one provider's facts, the unit that a consumer reads."""
    pair = F.struct(F.col("fact_key").alias("key"), F.col("value_json").alias("value"))
    by_model = facts.groupBy("provider", "model").agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("facts"))
    own = by_model.where("model IS NULL").select("provider", F.col("facts").alias("own"))
    models = by_model.where("model IS NOT NULL").groupBy("provider").agg(F.map_from_entries(F.collect_list(F.struct("model", "facts"))).alias("models"))
    return models.join(own, "provider", "full_outer").select("provider", F.to_json(F.struct(F.col("own").alias("facts"), "models")).alias("document"))


def read_snapshot(snapshot: DataFrame) -> DataFrame:
    """Back to facts: (provider, model, fact_key, value_json)."""
    d = snapshot.select("provider", F.from_json("document", "struct<facts map<string,string>, models map<string,map<string,string>>>").alias("d"))
    own = d.select("provider", F.lit(None).cast("string").alias("model"), F.explode("d.facts").alias("fact_key", "value_json"))
    each = d.select("provider", F.explode("d.models").alias("model", "f")).select("provider", "model", F.explode("f").alias("fact_key", "value_json"))
    return own.unionByName(each)


def export_models(facts: DataFrame) -> DataFrame:
    """One row per model, (provider, model, document): its facts as one JSON object; provider facts have a null model. To be written by
    provider, in as many files as it takes, so no row or task holds a provider."""
    pair = F.struct(F.col("fact_key").alias("key"), F.col("value_json").alias("value"))
    return facts.groupBy("provider", "model").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair)))).alias("document"))


def read_models(exported: DataFrame) -> DataFrame:
    """Back to facts: (provider, model, fact_key, value_json)."""
    return exported.select("provider", "model", F.explode(F.from_json("document", "map<string,string>")).alias("fact_key", "value_json"))


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """Release files -> ops: (release, parent, published_at_ms, pos, op, provider, model, fact_key, value as canonical JSON); see
    factledger.sources.releases for the envelopes and their hashes. A file of another shape stops the job."""
    from factledger.sources import releases

    return releases.ops(releases.read_release_files(spark, path))


def provider_directory(models: DataFrame, hand_kept: DataFrame) -> DataFrame:
    """models(provider, name, doc, modalities and, if they are there, env array and type) and hand-kept providers: one row each with the
    sorted union of output modalities, to which a model of type embedding adds `embedding`. A hand-kept id that upstream has too stops
    the job."""
    more = F.when(F.col("type") == "embedding", F.array(F.lit("embedding"))).otherwise(F.array().cast("array<string>")) if "type" in models.columns else F.array().cast("array<string>")
    env = [F.first("env", ignorenulls=True).alias("env")] if "env" in models.columns else []
    said = models.withColumn("modalities", F.concat(F.coalesce("modalities", F.array().cast("array<string>")), more))
    up = said.groupBy("provider").agg(F.max("name").alias("name"), F.max("doc").alias("doc"), *env, F.array_sort(F.array_distinct(F.flatten(F.collect_set("modalities")))).alias("modalities"))
    clash = hand_kept.join(up.select(F.col("provider"), F.lit(True).alias("_up")), "provider", "left")
    own = [F.col(c) for c in ("name", "doc", *(["env"] if env else []))]
    kept = clash.select(F.when(F.col("_up"), F.raise_error(F.lit("a hand-kept provider clashes with upstream"))).otherwise(F.col("provider")).alias("provider"), *own, F.array_sort("modalities").alias("modalities"))
    return up.unionByName(kept)


def size_profile(facts: DataFrame, by: str = "provider") -> DataFrame:
    """Bytes and facts per provider as serialised, to plan exports that keep providers whole."""
    return facts.groupBy(by).agg(F.sum(F.octet_length(F.to_json(F.struct("fact_key", "value_json")))).alias("bytes"), F.count(F.lit(1)).alias("facts"))


def page_plan(profile: DataFrame, limit: int, by: str = "provider", envelope: int = 0, token: int = 0, after: str | None = None) -> DataFrame:
    """(provider, bytes, page, page_bytes) of profile(provider, bytes, ...): whole providers in the order of their names on pages of at most `limit` bytes,
    each page as full as that order allows; one that is above the limit by itself has a page of its own. A page holds `envelope` bytes
    besides, and one that isn't the last also `token` bytes and the name of its last provider, to go on from; after: go on from there, as a
    plan from the start would only if that name ends a page of it. One row for each provider passes through one task, as a running sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, used, filled, held = 0, envelope, False, None
        out: list[tuple] = []

        def place(name: str, size: int, last: bool) -> None:
            nonlocal page, used, filled
            end = 0 if last else token + len(name.encode())
            if filled and used + size + end > limit:
                page, used, filled = page + 1, envelope, False
            used, filled = used + size, True
            out.append((name, size, page, used + end))
            if used + end > limit:
                page, used, filled = page + 1, envelope, False

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=[by, "bytes", "page", "page_bytes"])
            out.clear()
            return batch

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is not None:
                    place(*held, False)
                held = row
            yield flush()
        if held is not None:
            place(*held, True)
        yield flush()

    rows = profile.select(F.col(by), F.col("bytes").cast("long")).where(F.col(by).isNotNull() if after is None else F.col(by) > after)
    return rows.repartition(1).sortWithinPartitions(by).mapInArrow(run, f"`{by}` string, bytes long, page long, page_bytes long")
