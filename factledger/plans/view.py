"""The served view: recorded facts at an instant, under the layers, in their fixed order.

Entities are folded once (one row each, see operators.layers); every layer is an expression and a join with a rule table, and
the facts are unfolded at the end. Order matters: overrides run before the table of endpoint corrections, rates are inherited
before lifetimes are priced, a billing plane comes after all derived facts, speed twins after the plane, and narrowing
to the asked prefixes is last, since a derived fact may need inputs that were not asked for.

A dated read applies only what has a history: overrides, lifetimes and judgments, as its caller resolved them for the instant
(asof.as_of, ledger.latest_judgments), and corrections. Nothing is inherited, aliased or curated into a past state, so a fact
that a correction withholds stays withheld.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions.keys import has_prefix, is_mode_rate
from factledger.functions.claims import put, quoted, text_of
from factledger.operators import judged, layers
from factledger.operators.asof import select_prefixes
from factledger.operators.corrections import corrections_at, uncertain
from factledger.operators.layers import ID, fact_map

KEYS = [*ID, "fact_key"]
OPTIONS, CANONICAL, FAMILY = "capability.reasoning_options", "model.canonical_id", "model.family"
_RATES = ["rate.", FAMILY, "model.open_weights"]
#: What a derived fact is made from, besides itself.
NEEDS = {
    "rate.": [*_RATES, CANONICAL], "route.": ["rate.", OPTIONS], "model.mode_of": ["rate."], "model.lineage": [FAMILY, CANONICAL], "capability.cache_lifetimes": ["rate."], "capability.reasoning_default": [OPTIONS],
    "limit.": ["capability.input_modalities", "limit.", "capability.temperature", *_RATES], "quality.": [OPTIONS, CANONICAL, "model.type"], "workload.": [OPTIONS, CANONICAL], "wire.": ["wire."],
}


@dataclass
class Plane:
    """A billing plane of a provider: how a login is charged. kind: upstream (published rates stand) or quota_proxy."""

    provider: str
    method: str
    kind: str = "upstream"
    rates_from: str | None = None
    family: str | None = None


@dataclass
class Rules:
    """Rule tables; a layer whose table is None is skipped. Their columns are in the docstrings of operators.layers and judged."""

    overrides: DataFrame | None = None
    endpoints: DataFrame | None = None  # wire.api by provider and model
    complete: DataFrame | None = None  # providers whose endpoints are all listed
    families: DataFrame | None = None
    links: DataFrame | None = None
    creators: DataFrame | None = None
    aliases: DataFrame | None = None
    curated: DataFrame | None = None
    held: DataFrame | None = None
    logins: DataFrame | None = None
    lifetimes: DataFrame | None = None
    limits: DataFrame | None = None
    ranges: DataFrame | None = None
    audio: DataFrame | None = None
    audio_overrides: DataFrame | None = None
    lineage: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None
    judgments: DataFrame | None = None  # judged.judgments(...)
    plane_rules: DataFrame | None = None
    twins: DataFrame | None = None
    retired: DataFrame | None = None
    policy: str | None = None  # the policy that units are assumed by


@dataclass
class ServedView:
    facts: DataFrame  # provider, model, fact_key, value_json
    entities: DataFrame  # folded, with what the layers disclose: overridden, alias_of, curated, login_methods, ruled, judged_at_ms
    withheld: DataFrame | None
    uncertain: DataFrame | None


def widen(prefixes: list[str] | None) -> list[str] | None:
    if not prefixes:
        return prefixes
    more = [n for p in prefixes for k, needs in NEEDS.items() if p.startswith(k) or k.startswith(p) for n in needs]
    return sorted({*prefixes, *more, "existence"})


def states(eras: DataFrame, at: int | None, covering: DataFrame | None = None) -> DataFrame:
    """Every entity that was ever recorded: facts in force (narrow rows, one aggregation per fact and one per entity) and `withheld`, the
    keys that a correction covers. One shuffle, by entity: both aggregations and the records of corrections follow it, and nothing is
    sorted before it, where a task has as many facts as its file."""
    told = eras.select(*KEYS, "value_json", "boundary", "id", F.lit(False).alias("_hit"))
    valid = F.struct("boundary", "id") if at is None else F.when(F.col("boundary") <= at, F.struct("boundary", "id"))
    if covering is not None:  # a record meets facts of its own key, and a null in a key meets none
        none = [F.lit(None).cast(told.schema[c].dataType).alias(c) for c in ("value_json", "boundary", "id")]
        told = told.unionByName(covering.dropna(subset=KEYS).select(*[F.col(c).cast(told.schema[c].dataType).alias(c) for c in KEYS], *none, F.lit(True).alias("_hit")))
    now = told.repartition(*ID).groupBy(*KEYS).agg(F.max_by(F.struct("value_json"), F.when(~F.col("_hit"), valid)).alias("v"), F.max("_hit").alias("_hit"), F.min("_hit").alias("_only"))
    now, hit = now.where(~F.col("_only")), F.col("_hit")
    entry = F.when(F.col("v").isNotNull() & ~hit, F.struct("fact_key", F.col("v.value_json")))
    return now.groupBy(*ID).agg(F.map_from_entries(F.collect_list(entry)).alias("facts"), F.collect_list(F.when(F.col("v").isNotNull() & hit, F.col("fact_key"))).alias("withheld"))


def in_scope(provider: str | None, model: str | None, columns: tuple[str, str] = ("provider", "model")) -> Column | None:
    """Whether an entity is asked for; None if all are."""
    tests = [F.col(c) == v for c, v in zip(columns, (provider, model)) if v is not None]
    return reduce(lambda a, b: a & b, tests) if tests else None


def read_scope(eras: DataFrame, rules: Rules, provider: str | None, model: str | None, plane: Plane | None = None) -> DataFrame:
    """The eras that a scoped read needs: those of the scope, of the twins and bases of what it asks for, of the targets of its aliases (and of
    aliases among those twins), of the cards that creators lend to any of these, and of the provider whose rates a plane borrows. Who is needed
    is read from the rule tables, by semi-joins that leave the rest of the ledger unread; entities may be more than needed, never fewer."""
    asked = in_scope(provider, model)
    if asked is None:
        return eras
    pairs: list[DataFrame] = []  # (provider, model)
    spark = eras.sparkSession
    if rules.twins is not None and model is not None:  # of a whole provider they are in the scope
        of = lambda a, b: rules.twins.where(in_scope(provider, model, ("provider", a))).select("provider", F.col(b).alias("model"))
        pairs += [of("base", "twin"), of("twin", "base")]
    if rules.aliases is not None:
        target = [F.col("target_provider").alias("provider"), F.col("target").alias("model")]
        more = [rules.aliases.join(reduce(DataFrame.unionByName, pairs).distinct(), ID, "left_semi").select(*target)] if pairs else []
        pairs += [rules.aliases.where(asked).select(*target), *more]
    one = reduce(DataFrame.unionByName, pairs).distinct() if pairs else None
    other = eras.where(~F.coalesce(asked, F.lit(False)))
    out, covered = eras.where(asked), None  # covered: providers of which all that could be needed is read
    if plane is not None and plane.rates_from is not None:
        covered = spark.createDataFrame([(plane.rates_from,)], "provider string")
        out = out.unionByName(other.join(covered, "provider", "left_semi"))
    if rules.creators is not None:
        lenders = rules.creators.select(F.col("creator").alias("provider")).distinct()
        fresh = lenders if covered is None else lenders.join(covered, "provider", "left_anti")
        cards = other.join(fresh, "provider", "left_semi")
        if model is not None:  # a card is lent to the same model of another provider
            asked_for = spark.createDataFrame([(model,)], "model string")
            models = asked_for if one is None else asked_for.unionByName(one.select("model")).distinct()
            cards = cards.join(models, "model", "left_semi")
        out = out.unionByName(cards)
        covered = lenders if covered is None else covered.unionByName(lenders).distinct()
    if one is not None:
        out = out.unionByName(other.join(one if covered is None else one.join(covered, "provider", "left_anti"), ID, "left_semi"))
    return out


def served_view(eras: DataFrame, rules: Rules, corrections: DataFrame | None = None, at: int | None = None, prefixes: list[str] | None = None, provider: str | None = None, model: str | None = None, include_retired: bool = False, method: str | None = None, plane: Plane | None = None) -> ServedView:
    """One lazy plan. Filters on provider, model and widened prefixes stand before the first aggregation, so they reach the scan. A scope
    (provider, model) reads what its facts are made from too (see read_scope) and is applied to the result, so a scoped view is the
    whole view, filtered."""
    mine = read_scope(eras, rules if at is None else Rules(), provider, model, plane)
    known = mine.select(*ID).distinct()
    rows = select_prefixes(mine, widen(prefixes))
    covering = None if at is None or corrections is None else corrections_at(corrections, at)
    e = states(rows, at, covering)
    held_back = None if covering is None else e.select(*ID, F.explode("withheld").alias("fact_key"))
    doubtful = None if at is None else uncertain(layers.unfold(e), rows, at, KEYS)
    seen = ['"present"', '"absent"'] if include_retired else ['"present"']
    e = layers.hide_nulls(e.where(fact_map()["existence"].isin(seen)), rules.policy)
    raw = e
    if rules.overrides is not None:
        e = layers.apply_overrides(e, rules.overrides)
    if at is None:
        e = _current(e, raw, known, rules, method)
    if rules.lifetimes is not None:
        e = layers.apply_lifetimes(e, rules.lifetimes)
    if at is None:
        if rules.limits is not None:
            e = judged.apply_limits(e, rules.limits)
        if rules.ranges is not None:
            e = layers.apply_ranges(e, rules.ranges)
        if rules.audio is not None:
            own = rules.audio.select("provider", F.lit(None).cast("string").alias("model"), "value").limit(0) if rules.audio_overrides is None else rules.audio_overrides
            e = judged.apply_audio(e, rules.audio, own)
        if rules.lineage is not None:
            e = layers.lineage(e, *rules.lineage)
    if rules.judgments is not None:
        e = judged.apply_judgments(e, rules.judgments, prefixes)
    if at is None:
        if plane is not None:
            e = _plane(e, raw, rules, plane)
        if rules.twins is not None:
            e = layers.apply_twins(e, rules.twins)
        if include_retired and rules.retired is not None:
            e = layers.apply_retired(e, rules.retired, known)
    asked = in_scope(provider, model)
    if asked is not None:
        e = e.where(asked)
        held_back, doubtful = (None if d is None else d.where(asked) for d in (held_back, doubtful))
    e = e.withColumn("facts", F.map_filter(fact_map(), lambda k, _: has_prefix(k, prefixes)))
    for disclosed in ("overridden", "ruled"):  # only what is still served, with the value it gave
        if disclosed in e.columns:
            e = e.withColumn(disclosed, F.map_filter(disclosed, lambda k, v: F.coalesce(fact_map()[k] == v, F.lit(False))))
    return ServedView(layers.unfold(e), e, held_back, doubtful)


def _current(e: DataFrame, raw: DataFrame, known: DataFrame, rules: Rules, method: str | None) -> DataFrame:
    """The layers that only a current read has, up to login methods."""
    none = known.limit(0)
    if rules.endpoints is not None:
        e = layers.apply_corrections_table(e, rules.endpoints, none if rules.complete is None else rules.complete, "wire.api")
    if rules.families is not None:
        e = layers.apply_families(e, rules.families)
    if rules.links is not None:
        e = layers.fill_missing(e, rules.links, CANONICAL)
    if rules.creators is not None:
        cards = layers.rate_cards(raw, rules.creators.select(F.col("creator").alias("provider")))
        e = layers.inherit_rates(e, rules.creators, cards)
    if rules.aliases is not None:
        e = layers.project_aliases(e, rules.aliases, known)
    if rules.curated is not None:
        e = layers.apply_curated(e, rules.curated, none if rules.held is None else rules.held, method)
    if rules.logins is not None:
        e = layers.apply_logins(e, rules.logins, method)
    return e


def _plane(e: DataFrame, raw: DataFrame, rules: Rules, plane: Plane) -> DataFrame:
    """The entities of the plane's provider as that login sees and pays them."""
    e = e.where(F.col("provider") == plane.provider)
    proxy = plane.kind == "quota_proxy"
    if plane.rates_from not in (None, plane.provider):
        target = text_of(fact_map()[CANONICAL])
        if rules.twins is not None and "api_card" in rules.twins.columns:  # a twin's card is named, not guessed from its canonical id
            t = rules.twins.select("provider", F.col("twin").alias("model"), F.col("api_card").alias("_card")).distinct()
            e, target = e.join(t, ID, "left"), F.coalesce("_card", target)
        under = F.when(target.startswith(f"{plane.rates_from}/"), F.substring(target, len(plane.rates_from) + 2, 10_000))
        of = raw.sparkSession.createDataFrame([(plane.rates_from,)], "provider string")
        e = layers.borrow_rates(e, layers.rate_cards(raw, of), under, plane.rates_from).drop("_card")
    if plane.method == "gateway":
        e = e.withColumn("facts", layers.without(lambda k: k == "wire.api"))  # the address belongs to the login
    if proxy:
        e = e.withColumn("facts", layers.without(is_mode_rate))
        if plane.rates_from in (None, plane.provider):
            marker = layers._marker(F.lit(plane.provider), text_of(fact_map()[FAMILY]), "quota_proxy")
            e = e.withColumn("facts", layers._marked(fact_map(), marker))
    if rules.plane_rules is not None:
        e = layers.apply_plane(e, rules.plane_rules, keep_published=not proxy)
    if plane.family is not None:
        open_ = ~F.coalesce(F.col("endpoint_withheld"), F.lit(False)) if "endpoint_withheld" in e.columns else F.lit(True)
        e = e.withColumn("facts", F.when(open_, put(fact_map(), F.lit("wire.family"), quoted(F.lit(plane.family)))).otherwise(fact_map()))
    return e
