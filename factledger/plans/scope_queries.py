"""Queries over scoped reads of the served view: what a scope's facts are made from lies outside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.plans.queries import query, table
from factledger.plans.view import Plane, Rules, served_view

#: (name, provider, model) of the scopes that the query reads.
SCOPES = (("heir", "p12", None), ("model", None, "m4"), ("alias", "p15", "al2"), ("base", "p4", "m6"))


def grid_eras(s, d) -> DataFrame:
    """Customers as entities of twenty providers that have the same models: the first ten state rates, the others have open weights and none."""
    k = F.col("c_custkey")
    p, m = (k % 20), F.floor(k / 20)
    one = lambda key, value: F.struct(F.lit(key).alias("fact_key"), value.alias("value_json"))
    price = F.when(p < 10, F.concat(F.lit('{"state":"priced","units":'), k.cast("string"), F.lit("}")))
    facts = F.array(one("existence", F.lit('"present"')), one("model.family", F.concat(F.lit('"f'), (p % 4).cast("string"), F.lit('"'))), one("model.open_weights", (p >= 10).cast("string")), one("rate.input", price))
    rows = table(s, d, "customer").select(F.concat(F.lit("p"), p.cast("string")).alias("provider"), F.concat(F.lit("m"), m.cast("string")).alias("model"), F.explode(facts).alias("f"))
    e = rows.where("f.value_json IS NOT NULL").select("provider", "model", "f.*")
    return e.withColumn("boundary", F.lit(1).cast("long")).withColumn("id", F.lit(1).cast("long")).withColumn("prior_ms", F.lit(None).cast("long"))


def grid_rules(s, d) -> Rules:
    """Four families whose creators are p0 to p3; aliases of p10 to p19 for models of other providers; fast twins of every second model of p0 to p9."""
    k = F.col("c_custkey")
    p, m = (k % 20), F.floor(k / 20)
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    c = table(s, d, "customer").select(p.alias("p"), m.alias("m"))
    creators = s.range(4).select(named("f", F.col("id")).alias("family"), named("p", F.col("id")).alias("creator"))
    target = F.when(F.col("p") % 2 == 0, F.col("p") % 10).otherwise(F.col("p") - 1)  # a provider with rates, or another heir
    aliases = c.where("p >= 10").select(named("p", F.col("p")).alias("provider"), named("al", F.col("m")).alias("model"), named("p", target).alias("target_provider"), named("m", F.col("m")).alias("target"))
    twins = c.where("p < 10 AND m % 2 = 0").select(named("p", F.col("p")).alias("provider"), named("m", F.col("m")).alias("base"), F.lit("fast").alias("mode"), named("m", F.col("m") + 1).alias("twin"), F.lit("Fast").alias("label"))
    return Rules(creators=creators, aliases=aliases, twins=twins)


_GRID = """c AS (SELECT c_custkey AS k, c_custkey % 20 AS p, c_custkey // 20 AS m FROM customer),
lend AS (SELECT h.p, h.m, '{"state":"priced","units":' || l.k || ',"inherited_from":{"basis":"open_weights","family":"f' || (h.p % 4) || '","provider_id":"p' || l.p || '"}}' AS v FROM c h JOIN c l ON h.p >= 10 AND l.p = h.p % 4 AND l.m = h.m),
rate AS (SELECT p, m, '{"state":"priced","units":' || k || '}' AS v FROM c WHERE p < 10 UNION ALL SELECT * FROM lend),
al AS (SELECT a.p, a.m, t.p AS tp FROM c a JOIN c t ON a.p >= 10 AND t.m = a.m AND t.p = CASE WHEN a.p % 2 = 0 THEN a.p % 10 ELSE a.p - 1 END),
tw AS (SELECT b.p, b.m, t.k AS tk FROM c b JOIN c t ON b.p < 10 AND b.m % 2 = 0 AND t.p = b.p AND t.m = b.m + 1),
of AS (SELECT p, m + 1 AS m, m AS base FROM c WHERE p < 10 AND m % 2 = 0),
whole AS (SELECT 'p' || p AS provider, 'm' || m AS model, unnest(['existence', 'model.family', 'model.open_weights']) AS fact_key, unnest(['"present"', '"f' || (p % 4) || '"', CASE WHEN p >= 10 THEN 'true' ELSE 'false' END]) AS value_json FROM c
UNION ALL SELECT 'p' || p, 'm' || m, 'rate.input', v FROM rate
UNION ALL SELECT 'p' || p, 'al' || m, unnest(['existence', 'model.family', 'model.open_weights']), unnest(['"present"', '"f' || (tp % 4) || '"', CASE WHEN tp >= 10 THEN 'true' ELSE 'false' END]) FROM al
UNION ALL SELECT 'p' || al.p, 'al' || al.m, 'rate.input', CASE WHEN tp >= 10 THEN v ELSE left(v, length(v) - 1) || ',"inherited_from":{"basis":"alias","family":"f' || (tp % 4) || '","model_id":"m' || al.m || '","provider_id":"p' || tp || '"}}' END FROM al JOIN rate r ON r.p = al.tp AND r.m = al.m
UNION ALL SELECT 'p' || p, 'm' || m, unnest(['rate.input.mode.fast', 'route.mode_wire_ids', 'route.mode_labels']), unnest(['{"state":"priced","units":' || tk || '}', '{"fast":"m' || (m + 1) || '"}', '{"fast":"Fast"}']) FROM tw
UNION ALL SELECT 'p' || c.p, 'm' || c.m, 'model.mode_of', '{"mode":"fast","model_id":"m' || base || '"}' FROM c JOIN of ON of.p = c.p AND of.m = c.m)"""


@query("served_scoped", f"""WITH {_GRID}, s AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {'NULL' if p is None else repr(p)}, {'NULL' if m is None else repr(m)})" for n, p, m in SCOPES)}) s(scope, sp, sm))
SELECT scope, provider, model, fact_key, value_json FROM whole JOIN s ON coalesce(provider = sp, true) AND coalesce(model = sm, true) UNION ALL SELECT 'whole', * FROM whole""")
def _(s, d):
    """The whole view, and each scope read by itself."""
    eras, rules = grid_eras(s, d), grid_rules(s, d)
    out = served_view(eras, rules).facts.select(F.lit("whole").alias("scope"), "provider", "model", "fact_key", "value_json")
    for name, provider, model in SCOPES:
        one = served_view(eras, rules, provider=provider, model=model).facts
        out = out.unionByName(one.select(F.lit(name).alias("scope"), "provider", "model", "fact_key", "value_json"))
    return out


@query("scoped_plane", f"""WITH {_GRID}, h AS (SELECT h.p, h.m, l.k FROM c h LEFT JOIN c l ON l.p = 5 AND l.m = h.m AND h.m % 2 = 0 WHERE h.p = 14)
SELECT 'm' || m AS model, 'rate.input' AS fact_key, CASE WHEN k IS NULL THEN '{{"reason":"no_api_card","state":"unpriced"}}' ELSE '{{"state":"priced","units":' || k || ',"inherited_from":{{"basis":"quota_proxy","family":"f1","model_id":"m' || m || '","provider_id":"p5"}}}}' END AS value_json FROM h""")
def _(s, d):
    """A subscription of one provider that borrows another's cards, read under its own scope: the lender's cards are read with it."""
    eras, rules = grid_eras(s, d), Rules()
    k = F.col("c_custkey")
    links = table(s, d, "customer").where((k % 20 == 14) & (F.floor(k / 20) % 2 == 0)).select(F.lit("p14").alias("provider"), F.concat(F.lit("m"), F.floor(k / 20).cast("string")).alias("model"), F.concat(F.lit('"p5/m'), F.floor(k / 20).cast("string"), F.lit('"')).alias("value"))
    rules.links = links
    v = served_view(eras, rules, provider="p14", plane=Plane("p14", "oauth", "quota_proxy", rates_from="p5")).facts
    return v.where("fact_key = 'rate.input'").select("model", "fact_key", "value_json")
