"""Layers over recorded facts: rules that fill, replace, inherit and re-price.

An entity is one row (provider, model, facts map), so a layer is an expression over the map and a join with a small rule
table on the entity, its provider or its family; the facts themselves are folded once and unfolded once, whatever the
number of layers. Rule tables by provider or family are left to Spark's own broadcast threshold; those by entity may be as many
as entities are and are merged with them (by_entity), on keys by which the entities are dealt already. An entity has
some dozens of facts, so its map is small; entities are as many as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions.claims import has_key, lists, merged, put, put_all, quoted, same_claim, text_of, with_field
from factledger.functions.keys import is_mode_rate
from factledger.functions.money import exact_ratio, nano_amount

ID = ["provider", "model"]
KEY = [*ID, "fact_key"]
FACT = [*KEY, "value_json"]
EMPTY = "map<string,string>"
#: Facts of an endpoint, which an alias that is served elsewhere doesn't take from its target.
ROUTE_FACTS = ("model.name", "provider.name", "capability.structured_output", "limit.temperature_min", "limit.temperature_max", "capability.server_side_fallback", "capability.mid_conversation_system", "capability.reasoning_default", "wire.npm", "wire.api", "wire.shape", "wire.family")
#: Rate classes that are said to have no price where a card that is asked for doesn't exist.
BASE_CLASSES = ("input", "output", "cache_read", "cache_write", "reasoning")
NO_CARD, NOT_ESTABLISHED, ZERO = '{"reason":"no_api_card","state":"unpriced"}', '{"reason":"not_established","state":"unpriced"}', '{"state":"stated_zero"}'


def fact_map() -> Column:
    return F.col("facts")


def fold(facts: DataFrame, *others: Column) -> DataFrame:
    """Facts, one row per key, as one row per entity."""
    entry = F.struct("fact_key", "value_json")
    return facts.groupBy(*ID).agg(F.map_from_entries(F.collect_list(entry)).alias("facts"), *others)


def unfold(entities: DataFrame, *others: str) -> DataFrame:
    """Back to facts. For a plain explode Spark adds a filter on the size of the map, which computes every layer a second time below."""
    return entities.select(*ID, *others, F.explode_outer("facts").alias("fact_key", "value_json")).where("fact_key IS NOT NULL").select(*FACT, *others)


def by_entity(table: DataFrame) -> DataFrame:
    """A table that may have a row for every entity (or key of one): it meets them by a merge and never goes whole to the driver and to every task. Spark's
    guess of its size comes from compressed files and is far too low for maps and arrays made of them."""
    return table.hint("merge")


def merge_layers(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def known_ids(facts: DataFrame) -> DataFrame:
    return facts.select(*ID).distinct()


def has(key: str | Column) -> Column:
    return F.map_contains_key(fact_map(), key)


def stated(said: dict[str, Column]) -> Column:
    """A map of the keys whose value isn't null."""
    entries = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in said.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda x: x["v"].isNotNull()))


def without(test) -> Column:
    """The facts but for those whose key passes the test."""
    return F.map_filter(fact_map(), lambda k, _: ~test(k))


def hide_nulls(e: DataFrame, policy: str | None = None) -> DataFrame:
    """Withdrawn names, types and connection claims are in the history as null; they are not served. With a policy, a priced rate that doesn't
    say where its unit comes from says that it is assumed by it."""
    hidden = lambda k, v: (v == "null") & (k.startswith("wire.") | k.isin("model.name", "provider.name", "model.type"))
    facts = F.map_filter(fact_map(), lambda k, v: ~hidden(k, v))
    if policy is not None:
        said = F.lit('{"kind":"assumed_by_policy","policy":"%s"}' % policy)
        facts = F.transform_values(facts, lambda k, v: F.when(k.startswith("rate.") & (F.get_json_object(v, "$.state") == "priced"), with_field(v, "unit_provenance", said)).otherwise(v))
    return e.withColumn("facts", facts)


def apply_overrides(e: DataFrame, overrides: DataFrame, additions: tuple[str, ...] | None = None) -> DataFrame:
    """overrides(KEY, value, replaces). Keys that upstream doesn't record (`additions`, by default rules.ADDED_ONLY) are added only where the entity has no such fact, not
    even null, and the key isn't among `withheld` (an array of keys, if e has it). Any other fact is replaced, only while upstream
    still says `replaces`; a replaces of null stands for a null that is stored, so a fact that isn't there is not replaced. A default effort
    must be among the efforts that the entity lists. Adds the column overridden: the facts that an override gave."""
    from factledger.functions.claims import listed_efforts
    from factledger.operators.rules import ADDED_ONLY

    rows = overrides.groupBy(*ID).agg(F.map_from_entries(F.collect_list(F.struct("fact_key", F.struct("value", "replaces")))).alias("_o"))
    held = F.coalesce(F.col("withheld"), F.array().cast("array<string>")) if "withheld" in e.columns else F.array().cast("array<string>")
    efforts = listed_efforts(F.col("facts")["capability.reasoning_options"])

    def applies(k: Column, o: Column) -> Column:
        there = F.map_contains_key(fact_map(), k)
        addition = k.isin(*(ADDED_ONLY if additions is None else additions))
        replaced = ~addition & there & same_claim(fact_map()[k], F.coalesce(o["replaces"], F.lit("null")))
        added = addition & ~there & ~F.array_contains(held, k)
        fits = (k != "capability.reasoning_default") | F.array_contains(efforts, F.get_json_object(o["value"], "$.value"))
        return F.coalesce((replaced | added) & fits, F.lit(False))

    m = e.join(by_entity(rows), ID, "left")
    m = m.withColumn("overridden", F.coalesce(F.transform_values(F.map_filter("_o", applies), lambda _, o: o["value"]), F.create_map().cast(EMPTY)))
    return m.withColumn("facts", put_all(fact_map(), F.col("overridden"))).drop("_o")


def apply_corrections_table(e: DataFrame, rules: DataFrame, complete: DataFrame, key: str) -> DataFrame:
    """Precedence for one fact key of every entity: an exact rule's value (null: withheld); else withheld where the provider is complete;
    else the recorded value; else the provider's `*` value. rules(provider, model, value). Adds the column endpoint_withheld."""
    exact = rules.where("model <> '*'").select(*ID, F.struct("value").alias("_exact"))
    star = rules.where("model = '*'").select("provider", F.col("value").alias("_star"))
    done = complete.select("provider", F.lit(True).alias("_done")).distinct()
    m = e.join(by_entity(exact), ID, "left").join(star, "provider", "left").join(done, "provider", "left")
    ruled, value = F.col("_exact").isNotNull(), F.col("_exact.value")
    withheld = F.when(ruled, value.isNull()).otherwise(F.coalesce("_done", F.lit(False)))
    put_value = F.when(ruled, value).when(~has(key), F.col("_star"))
    facts = F.when(withheld, without(lambda k: k == key)).when(put_value.isNotNull(), put(fact_map(), F.lit(key), put_value)).otherwise(fact_map())
    return m.select(*e.columns, facts.alias("_f"), withheld.alias("endpoint_withheld")).withColumn("facts", F.col("_f")).drop("_f")


def lookup_null_safe(left: DataFrame, rules: DataFrame, on: list[str], value: str) -> DataFrame:
    """Left join in which null is a value like any other, not a wildcard."""
    r = rules.select(*[F.col(c).alias(f"_{c}") for c in on], value)
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"_{c}"]) for c in on])
    return left.join(r, cond, "left").drop(*[f"_{c}" for c in on])


def apply_families(e: DataFrame, families: DataFrame) -> DataFrame:
    """families(npm, shape, family): wire.family by package and shape, unless the endpoint is withheld."""
    said = e.withColumn("npm", F.get_json_object(fact_map()["wire.npm"], "$.value")).withColumn("shape", F.get_json_object(fact_map()["wire.shape"], "$.value"))
    met = lookup_null_safe(said, families, ["npm", "shape"], "family")
    serve = F.col("family").isNotNull() & (~F.col("endpoint_withheld") if "endpoint_withheld" in e.columns else F.lit(True))
    return met.withColumn("facts", F.when(serve, put(fact_map(), F.lit("wire.family"), quoted(F.col("family")))).otherwise(fact_map())).select(*e.columns)


def fill_missing(e: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """rules(provider, model, value) become the fact `key` of entities that lack it or hold null."""
    met = e.join(by_entity(rules.select(*ID, F.col("value").alias("_v"))), ID, "left")
    add = F.col("_v").isNotNull() & F.coalesce(fact_map()[key] == "null", F.lit(True))
    return met.withColumn("facts", F.when(add, put(fact_map(), F.lit(key), F.col("_v"))).otherwise(fact_map())).drop("_v")


def _marker(provider: Column, family: Column, basis: str, model: Column | None = None) -> Column:
    fields = [F.lit(basis).alias("basis"), F.coalesce(family, F.lit("")).alias("family")] + ([model.alias("model_id")] if model is not None else []) + [provider.alias("provider_id")]
    return F.to_json(F.struct(*fields))


def _marked(rates: Column, marker: Column) -> Column:
    return F.transform_values(rates, lambda k, v: F.when(k.startswith("rate."), with_field(v, "inherited_from", marker)).otherwise(v))


def rate_cards(e: DataFrame, by: DataFrame) -> DataFrame:
    """(provider, model, card): the rates of entities of the providers in by(provider), with model.family beside them."""
    card = F.map_filter(fact_map(), lambda k, _: k.startswith("rate.") | (k == "model.family"))
    return e.join(by.select("provider").distinct(), "provider", "left_semi").select(*ID, card.alias("card"))


def inherit_rates(e: DataFrame, creators: DataFrame, cards: DataFrame) -> DataFrame:
    """An entity without any rate whose model.open_weights is true and whose family has a creator (creators(family, creator)) takes
    that provider's rates for the same model, mode rates left out, marked with inherited_from."""
    none = ~F.exists(F.map_keys(fact_map()), lambda k: k.startswith("rate."))
    heir = none & (fact_map()["model.open_weights"] == "true")
    m = e.withColumn("family", F.when(heir, text_of(fact_map()["model.family"]))).join(creators, "family", "left")
    c = cards.select(F.col("provider").alias("creator"), "model", "card")
    m = m.join(by_entity(c), ["creator", "model"], "left")
    got = F.map_filter("card", lambda k, _: k.startswith("rate.") & ~is_mode_rate(k))
    take = F.col("card").isNotNull() & (F.col("creator") != F.col("provider"))
    facts = F.when(take, put_all(fact_map(), _marked(got, _marker(F.col("creator"), F.col("family"), "open_weights")))).otherwise(fact_map())
    return m.withColumn("facts", facts).select(*e.columns)


ALIAS = "provider string, model string, target_provider string, target string, name string, wire_family string, wire_ids map<string,string>, default_effort string, output_limit long"


def project_aliases(e: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """e and a row for each alias (see ALIAS) whose id was never recorded (known: every id that ever was) and whose target is in e: the
    target's facts but for those of its endpoint (capability.temperature stays where it is false), with the alias's own name, family,
    efforts and limit; rates say through which row they are borrowed, unless they are inherited already. One hop only. Adds
    the column alias_of, null for entities of their own."""
    from factledger.functions.claims import restricted_options

    columns = [f.split()[0] for f in ALIAS.split(", ")]
    own = [F.col(c) if c in aliases.columns else F.lit(None).cast(f.split(" ", 1)[1]).alias(c) for c, f in zip(columns, ALIAS.split(", "))]
    live = aliases.select(*own).join(by_entity(known.select(*ID)), ID, "left_anti")
    to = live.groupBy(F.col("target_provider").alias("_p"), F.col("target").alias("_m")).agg(F.collect_list(F.struct(*columns)).alias("_a"))
    m = e.join(by_entity(to), (e["provider"] == F.col("_p")) & (e["model"] == F.col("_m")), "left").drop("_p", "_m")
    me = F.lit(None).cast(f"struct<{', '.join(f.replace(' ', ': ', 1) for f in ALIAS.split(', '))}>")
    m = m.withColumn("_a", F.explode(F.concat(F.array(me), F.coalesce("_a", F.array().cast(m.schema["_a"].dataType)))))
    a = F.col("_a")
    kept = without(lambda k: k.isin(*ROUTE_FACTS) | k.startswith("route.") | ((k == "capability.temperature") & (F.coalesce(fact_map()["capability.temperature"], F.lit("")) != "false")))
    m = m.withColumn("_tp", F.col("provider")).withColumn("_tm", F.col("model"))  # a lambda would take the names below for the alias's own
    kept = _marked(kept, _marker(F.col("_tp"), text_of(fact_map()["model.family"]), "alias", F.col("_tm")))
    mapped = F.coalesce(F.size(a["wire_ids"]) > 0, F.lit(False))
    options = "capability.reasoning_options"
    said = {
        "wire.family": quoted(a["wire_family"]), "model.name": quoted(a["name"]), "limit.output": a["output_limit"].cast("string"),
        options: F.when(mapped & has(options), restricted_options(fact_map()[options], a["wire_ids"])),
        "route.reasoning_wire_ids": F.when(mapped, F.to_json(a["wire_ids"])), "route.reasoning_default": quoted(a["default_effort"]),
    }
    said = stated(said)
    facts = F.when(a.isNull(), fact_map()).otherwise(put_all(kept, said))
    of = F.when(a.isNotNull(), F.struct(F.col("provider"), F.col("model")))
    rest = [c for c in e.columns if c not in (*ID, "facts")]
    return m.select(F.coalesce(a["provider"], "provider").alias("provider"), F.coalesce(a["model"], "model").alias("model"), facts.alias("facts"), of.alias("alias_of"), *rest)


def apply_curated(e: DataFrame, curated: DataFrame, held: DataFrame, method: str | None = None) -> DataFrame:
    """curated(provider, model, facts map, auth_methods): rows of ids that are not held and that upstream does not have present (an alias
    doesn't count) replace what the id had, whole; with a login method only rows that allow it, the others leave nothing.
    e has existence among its facts where upstream knows the id. Adds the column curated."""
    rows = curated.join(held.select(*ID).distinct(), ID, "left_anti").select(*ID, F.col("facts").alias("_f"), F.col("auth_methods").alias("_auth"), F.lit(True).alias("curated"))
    m = e.join(rows, ID, "full_outer")
    present = F.coalesce(fact_map()["existence"] == '"present"', F.lit(False))
    if "alias_of" in e.columns:
        present = present & F.col("alias_of").isNull()
    m = m.withColumn("curated", F.coalesce("curated", F.lit(False)) & ~present)
    if method is not None:
        m = m.where(~F.col("curated") | F.coalesce(F.array_contains("_auth", method), F.lit(False)))
    return m.withColumn("facts", F.when(F.col("curated"), F.col("_f")).otherwise(fact_map())).drop("_f", "_auth")


def apply_logins(e: DataFrame, rows: DataFrame, method: str | None) -> DataFrame:
    """rows(provider, model, methods array): with a method, upstream's own entities whose list lacks it go; aliases and curated rows have
    lists of their own. Adds the column login_methods."""
    m = e.join(by_entity(rows.select(*ID, F.col("methods").alias("login_methods"))), ID, "left")
    own = reduce(lambda a, b: a & b, [F.col("alias_of").isNull() if "alias_of" in e.columns else F.lit(True), ~F.col("curated") if "curated" in e.columns else F.lit(True)])
    m = m.withColumn("login_methods", F.when(own, F.col("login_methods")))
    return m if method is None else m.where(F.col("login_methods").isNull() | F.array_contains("login_methods", method))


def apply_lifetimes(e: DataFrame, rules: DataFrame) -> DataFrame:
    """rules(provider, model, lifetimes array, ratios array<struct<ttl, num, den>>, shortest first): the fact capability.cache_lifetimes, and
    for every tier the price of each lifetime, the input's times an exact ratio. A tier whose write rate is not the shortest
    lifetime's price, or of which a product isn't whole, withholds the prices of the whole card. Inherited prices establish none."""
    m = e.join(by_entity(rules.select(*ID, F.col("lifetimes").alias("_l"), F.col("ratios").alias("_r"))), ID, "left")
    tier = r"^rate\.(?:input|cache_write)((?:\.above_context\.[0-9]+)?)$"
    tiers = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.filter(F.map_keys(fact_map()), lambda k: k.rlike(tier)), lambda k: F.regexp_extract(k, tier, 1))))
    write = lambda t: fact_map()[F.concat(F.lit("rate.cache_write"), t)]
    told = F.transform(tiers, lambda t: F.struct(t.alias("tier"), nano_amount(fact_map()[F.concat(F.lit("rate.input"), t)]).alias("input"), write(t).alias("write"), nano_amount(write(t)).alias("nano")))
    m = m.withColumn("_t", F.when(F.col("_l").isNotNull(), told))  # a row's prices are read once, whatever is made of them
    cost = lambda t, r: exact_ratio(t["input"], r["num"], r["den"])
    sound = F.forall("_t", lambda t: F.coalesce((cost(t, F.col("_r")[0]) == t["nano"]) & F.forall("_r", lambda r: cost(t, r).isNotNull()), F.lit(False)))
    price = lambda t, r: F.regexp_replace(F.regexp_replace(t["write"], r'"units":[0-9]+', F.concat(F.lit('"units":'), cost(t, r).cast("string"))), r'"exponent":[0-9]+', '"exponent":9')
    entries = F.flatten(F.transform("_t", lambda t: F.transform("_r", lambda r: F.struct(F.concat(F.lit("rate.cache_write"), t["tier"], F.lit(".ttl."), r["ttl"]), price(t, r)))))
    priced = F.when((F.size("_r") > 0) & sound, F.map_from_entries(entries)).otherwise(F.create_map().cast(EMPTY))
    facts = put(put_all(fact_map(), priced), F.lit("capability.cache_lifetimes"), F.to_json("_l"))
    return m.withColumn("facts", F.when(F.col("_l").isNotNull(), facts).otherwise(fact_map())).drop("_l", "_r", "_t")


def apply_ranges(e: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(provider, low, high): limit.temperature_min and _max, unless the entity is an alias or its temperature is false."""
    m = e.join(ranges.select("provider", F.col("low").cast("string").alias("_lo"), F.col("high").cast("string").alias("_hi")), "provider", "left")
    told = F.col("_lo").isNotNull() & ~F.coalesce(fact_map()["capability.temperature"] == "false", F.lit(False))
    if "alias_of" in e.columns:
        told = told & F.col("alias_of").isNull()
    both = F.create_map(F.lit("limit.temperature_min"), F.col("_lo"), F.lit("limit.temperature_max"), F.col("_hi"))
    return m.withColumn("facts", F.when(told, put_all(fact_map(), both)).otherwise(fact_map())).select(*e.columns)


def lineage(e: DataFrame, by_model: DataFrame, by_family: DataFrame, by_lab: DataFrame, by_provider: DataFrame) -> DataFrame:
    """model.lineage: by exact id (provider/model); else, where there is a family and the entity is no alias, by family and nothing else;
    else, where there is a canonical id, by its lab and nothing else; else, of entities of their own, by provider. Tables are
    (key, class)."""
    is_alias = F.col("alias_of").isNotNull() if "alias_of" in e.columns else F.lit(False)
    m = e.withColumn("_id", F.concat_ws("/", *ID)).withColumn("_family", text_of(fact_map()["model.family"])).withColumn("_canon", text_of(fact_map()["model.canonical_id"]))
    m = m.withColumn("_lab", F.when(F.instr("_canon", "/") > 0, F.substring_index("_canon", "/", 1)))
    for name, table, col in (("_1", by_model, "_id"), ("_2", by_family, "_family"), ("_3", by_lab, "_lab"), ("_4", by_provider, "provider")):
        m = m.join(table.select(F.col("key").alias(col), F.col("class").alias(name)), col, "left")
    found = F.when(F.col("_1").isNotNull(), F.col("_1")).when(~is_alias & F.col("_family").isNotNull(), F.col("_2")).when(F.col("_canon").isNotNull(), F.col("_3")).when(~is_alias, F.col("_4"))
    return m.withColumn("facts", F.when(found.isNotNull(), put(fact_map(), F.lit("model.lineage"), quoted(found))).otherwise(fact_map())).select(*e.columns)


def borrow_rates(e: DataFrame, cards: DataFrame, target: Column, provider: str) -> DataFrame:
    """Rates of a subscription that borrows `provider`'s: target names the model whose card stands in, marked as quota_proxy; where there is
    no such card every rate, and the base classes, say unpriced for that reason."""
    c = cards.where(F.col("provider") == provider).select(F.col("model").alias("_t"), "card")
    m = e.withColumn("_t", target).join(c, "_t", "left")
    rest = without(lambda k: k.startswith("rate."))
    theirs = F.map_filter("card", lambda k, _: k.startswith("rate."))
    got = put_all(rest, _marked(theirs, _marker(F.lit(provider), text_of(F.col("card")["model.family"]), "quota_proxy", F.col("_t"))))
    none = F.transform_values(fact_map(), lambda k, v: F.when(k.startswith("rate."), F.lit(NO_CARD)).otherwise(v))
    none = put_all(none, F.map_from_arrays(F.array(*[F.lit(f"rate.{c}") for c in BASE_CLASSES]), F.array(*[F.lit(NO_CARD)] * len(BASE_CLASSES))))
    return m.withColumn("facts", F.when(F.col("card").isNotNull(), got).otherwise(none)).drop("_t", "card")


def apply_plane(e: DataFrame, rules: DataFrame, keep_published: bool) -> DataFrame:
    """A billing plane's rules(provider, class, action, target, model_ids array or null): for the base rate of the class, and for every
    context tier that the class (of billed_as also the target) has, the entity says billed_as with the target's key (not established
    where the target has no such rate), stated zero or not established. Targets and tiers are those before any rule.
    keep_published leaves a rate that is there alone. Adds the column ruled: the facts that a rule gave."""
    rate = lambda c: F.concat(F.lit("rate."), c)
    billing = lambda key: F.to_json(F.struct(key.alias("key"), F.lit("billed_as").alias("state")))
    target = F.when(F.col("action") == "billed_as", rate("target"))
    other = F.when(F.col("action") == "stated_zero", F.lit(ZERO)).otherwise(F.lit(NOT_ESTABLISHED))
    # what a rule says is written once for the rule, and what tiers an entity has is read once for the entity, not once for every pair of them
    said = F.struct(rate("class").alias("key"), target.alias("target"), billing(target).alias("billed"), other.alias("other"), "model_ids")
    mine = rules.groupBy("provider").agg(F.collect_list(said).alias("_r"))
    tail = r"\.above_context\.[0-9]+$"
    tiered = F.filter(F.map_keys(fact_map()), lambda k: k.contains(".above_context.") & k.rlike(tail))
    tiered = F.transform(tiered, lambda k: F.struct(F.regexp_replace(k, tail, "").alias("key"), F.regexp_extract(k, tail, 0).alias("tail")))
    m = e.withColumn("_t", tiered).join(mine, "provider", "left")
    ours = F.filter(F.coalesce("_r", F.array().cast(m.schema["_r"].dataType)), lambda r: r["model_ids"].isNull() | lists(r["model_ids"], F.col("model")))

    def with_tiers(r: Column) -> Column:
        hit = F.filter("_t", lambda t: (t["key"] == r["key"]) | F.coalesce(t["key"] == r["target"], F.lit(False)))
        of = lambda t: F.concat(r["target"], t["tail"])
        above = F.transform(hit, lambda t: F.struct(F.concat(r["key"], t["tail"]).alias("key"), of(t).alias("target"), billing(of(t)).alias("billed"), r["other"].alias("other"), r["model_ids"].alias("model_ids")))
        return F.array_distinct(F.concat(F.array(r), above))

    m = m.withColumn("_r", F.when(F.size("_t") == 0, ours).otherwise(F.flatten(F.transform(ours, with_tiers))))
    value = lambda r: F.when(r["target"].isNotNull() & has_key(fact_map(), r["target"]), r["billed"]).otherwise(r["other"])
    m = m.withColumn("ruled", F.map_from_arrays(F.col("_r")["key"], F.transform("_r", value)))
    if keep_published:
        m = m.withColumn("ruled", F.map_filter("ruled", lambda k, _: ~has_key(fact_map(), k)))
    return m.withColumn("facts", merged(fact_map(), F.col("ruled"))).drop("_r", "_t")


def apply_twins(e: DataFrame, twins: DataFrame) -> DataFrame:
    """twins(provider, base, mode, twin, label): a twin's rates, but for mode rates, become the base's rates of that mode, in place of the base's
    own, where both are served; the base says route.mode_wire_ids and route.mode_labels, the twin model.mode_of. One shuffle: twins
    send their card to the row of their base."""
    t = twins.groupBy("provider", F.col("twin").alias("model")).agg(F.first(F.struct("base", "mode", "label")).alias("_t"))
    m = e.join(by_entity(t), ID, "left")
    of = F.to_json(F.struct(F.struct(F.col("_t.mode").alias("mode"), F.col("_t.base").alias("model_id")).alias("v")))
    of = F.regexp_extract(of, r'^\{"v":(.*)\}$', 1)
    plain = F.map_filter(fact_map(), lambda k, _: k.startswith("rate.") & ~is_mode_rate(k))
    moded = F.transform_keys(plain, lambda k, _: F.concat(F.regexp_extract(k, r"^rate\.[a-z0-9_]+", 0), F.lit(".mode."), F.col("_t.mode"), F.regexp_extract(k, r"^rate\.[a-z0-9_]+(.*)$", 1)))
    sent = F.when(F.col("_t").isNotNull(), F.struct(F.col("_t.base").alias("model"), F.lit(None).cast(e.schema["facts"].dataType).alias("facts"), F.struct(F.col("model").alias("twin"), F.col("_t.mode").alias("mode"), F.col("_t.label").alias("label"), moded.alias("rates")).alias("card")))
    self_facts = F.when(F.col("_t").isNotNull(), put(fact_map(), F.lit("model.mode_of"), of)).otherwise(fact_map())
    me = F.struct(F.col("model").alias("model"), self_facts.alias("facts"), F.lit(None).cast("struct<twin:string,mode:string,label:string,rates:map<string,string>>").alias("card"))
    rest = [c for c in e.columns if c not in (*ID, "facts")]
    carried = F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))
    parts = m.select("provider", F.explode(F.array_compact(F.array(F.struct(me.alias("x"), F.lit(True).alias("own")), F.when(sent.isNotNull(), F.struct(sent.alias("x"), F.lit(False).alias("own")))))).alias("y"), carried.alias("_rest"))
    parts = parts.select("provider", F.col("y.x.model").alias("model"), F.col("y.x.facts").alias("facts"), F.col("y.x.card").alias("card"), F.when(F.col("y.own"), F.col("_rest")).alias("_rest"))
    g = parts.groupBy(*ID).agg(F.first("facts", ignorenulls=True).alias("facts"), F.first("_rest", ignorenulls=True).alias("_rest"), F.array_sort(F.collect_list("card"), lambda a, b: F.when(a["mode"] < b["mode"], -1).when(a["mode"] > b["mode"], 1).otherwise(0)).alias("cards")).where("facts IS NOT NULL")
    rates = F.aggregate("cards", F.create_map().cast(EMPTY), lambda acc, c: put_all(acc, c["rates"]))
    named = lambda field: F.to_json(F.map_from_entries(F.transform(F.col("cards"), lambda c: F.struct(c["mode"], c[field]))))
    got = put_all(fact_map(), put_all(rates, F.create_map(F.lit("route.mode_wire_ids"), named("twin"), F.lit("route.mode_labels"), named("label"))))
    return g.select(*ID, F.when(F.size("cards") > 0, got).otherwise(fact_map()).alias("facts"), *[F.col("_rest")[c].alias(c) for c in rest])


def apply_retired(e: DataFrame, retired: DataFrame, known: DataFrame) -> DataFrame:
    """retired(provider, model, successor): ids that upstream never knew and that nothing serves get existence = "absent" and the successor."""
    rows = retired.join(by_entity(known.select(*ID)), ID, "left_anti").select(*ID, F.col("successor").alias("_s"), F.lit(True).alias("_x"))
    m = e.join(rows, ID, "full_outer")
    gone = F.create_map(F.lit("existence"), F.lit('"absent"'))
    gone = F.when(F.col("_s").isNotNull(), F.map_concat(gone, F.create_map(F.lit("successor"), quoted(F.col("_s"))))).otherwise(gone)
    return m.withColumn("facts", F.coalesce(fact_map(), F.when(F.col("_x"), gone))).drop("_s", "_x")


def overlay(published: DataFrame, local: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(local over published, disclosure of before and after where they differ). One full join of the two."""
    p = published.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_p"))
    mine = local.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_l"))
    met = p.join(mine, keys, "full_outer")
    merged = met.select(*keys, F.when(F.col("_l"), F.col("after")).otherwise(F.col("before")).alias(value))
    return merged, met.where(F.col("_l") & ~F.col("before").eqNullSafe(F.col("after"))).select(*keys, "after", "before")


def strictest_limits(entities: DataFrame, limits: DataFrame) -> DataFrame:
    """entities(provider, modalities array, context) x limits(provider, modality, limit, min_context): the strictest limit
    whose modality the entity has and whose context threshold (null: none) it reaches."""
    met = entities.join(limits, "provider").where(F.array_contains("modalities", F.col("modality")) & (F.col("min_context").isNull() | (F.col("context") >= F.col("min_context"))))
    return met.groupBy(*ID, "modality").agg(F.min("limit").alias("limit"))


def prune(disclosures: DataFrame, facts: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """Disclosures whose fact is still served (with `value`: with the same value)."""
    return disclosures.join(facts.select(*keys, *([value] if value else [])).distinct(), [*keys, *([value] if value else [])], "left_semi")
