"""Queries over releases: changes on two levels, nations with facts of their own and customers as their models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions.canonical import value_hash
from factledger.operators import diff
from factledger.plans.queries import query, table
from factledger.sources import releases

KEYS = ["provider", "model", "fact_key"]


def two_states(s, d) -> tuple[DataFrame, DataFrame]:
    """Facts of nations (null model) and of their customers, before and after: some customers and facts of nations come and go, some values
    change, and some are only spelled in another way."""
    c, n = table(s, d, "customer"), table(s, d, "nation")
    k, g = F.col("c_custkey"), F.col("n_nationkey")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    brand, model = F.col("c_nationkey").cast("string").alias("provider"), k.cast("string").alias("model")
    nested = F.concat(F.lit('{"z": [1.50, null], "a": "'), "c_mktsegment", F.lit('"}'))
    tidy = F.concat(F.lit('{"a":"'), "c_mktsegment", F.lit('","z":[1.50,null]}'))
    fact = lambda rows, key, value: rows.select(brand, model, F.lit(key).alias("fact_key"), value.alias("value_json"))
    own = lambda rows, key, value: rows.select(g.cast("string").alias("provider"), F.lit(None).cast("string").alias("model"), F.lit(key).alias("fact_key"), value.alias("value_json"))
    a, b = c.where(k % 5 != 0), c.where(k % 7 != 0)
    old = fact(a, "segment", tidy).unionByName(fact(a, "existence", F.lit('"present"'))).unionByName(own(n, "provider.name", quoted(F.col("n_name"))))
    new = fact(b, "segment", F.when(k % 3 == 0, F.lit("null")).otherwise(nested)).unionByName(fact(b, "existence", F.lit('"present"')))
    new = new.unionByName(own(n.where(g % 4 != 1), "provider.name", F.when(g % 4 == 0, F.lit('"renamed"')).otherwise(quoted(F.col("n_name")))))
    new = new.unionByName(own(n.where(g % 4 == 2), "provider.doc", F.lit("true")))
    return old, new


_CANON = """'{"a":"' || c_mktsegment || '","z":[1.50,null]}'"""
_STATES = f"""old AS (SELECT c_nationkey::VARCHAR AS provider, c_custkey::VARCHAR AS model, 'segment' AS fact_key, {_CANON} AS v FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_nationkey::VARCHAR, c_custkey::VARCHAR, 'existence', '"present"' FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT n_nationkey::VARCHAR, NULL, 'provider.name', '"' || n_name || '"' FROM nation),
new AS (SELECT c_nationkey::VARCHAR AS provider, c_custkey::VARCHAR AS model, 'segment' AS fact_key, CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE {_CANON} END AS v FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_nationkey::VARCHAR, c_custkey::VARCHAR, 'existence', '"present"' FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT n_nationkey::VARCHAR, NULL, 'provider.name', CASE WHEN n_nationkey % 4 = 0 THEN '"renamed"' ELSE '"' || n_name || '"' END FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT n_nationkey::VARCHAR, NULL, 'provider.doc', 'true' FROM nation WHERE n_nationkey % 4 = 2),
ops AS (SELECT coalesce(o.provider, n.provider) AS provider, coalesce(o.model, n.model) AS model, coalesce(o.fact_key, n.fact_key) AS fact_key, CASE WHEN n.v IS NULL THEN 'remove' ELSE 'set' END || CASE WHEN coalesce(o.model, n.model) IS NULL THEN '_provider' ELSE '' END AS op, n.v FROM old o FULL JOIN new n ON o.provider = n.provider AND o.model IS NOT DISTINCT FROM n.model AND o.fact_key = n.fact_key WHERE o.v IS DISTINCT FROM n.v),
lines AS (SELECT *, CASE WHEN model IS NULL THEN 1 ELSE 2 + model::BIGINT // 100 END AS release, '{{"fact":"' || fact_key || '"' || CASE WHEN model IS NULL THEN '' ELSE ',"model":"' || model || '"' END || ',"op":"' || op || '","provider":"' || provider || '"' || CASE WHEN v IS NULL THEN '' ELSE ',"value":' || v END || '}}' AS line FROM ops)"""


def change_ops(s, d) -> DataFrame:
    """The ops between the two states in releases: the nations' own in the first, a hundred customers in each of the others."""
    old, new = two_states(s, d)
    tidy = lambda f: f.withColumn("value_json", releases.canonical_json(F.col("value_json")))
    ops = diff.publish_delta(tidy(old), tidy(new), KEYS)
    release = F.when(F.col("model").isNull(), F.lit(1)).otherwise(F.floor(F.col("model").cast("long") / 100) + 2).cast("long")
    order = Window.partitionBy("release").orderBy("provider", F.col("model").asc_nulls_first(), "fact_key")
    return ops.withColumn("release", release).withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


@query("release_ops", f"WITH {_STATES} SELECT provider, model, fact_key, release, line, sha256(coalesce(v, 'null')) AS value_hash FROM lines")
def _(s, d):
    o = change_ops(s, d)
    line = releases.op_text(F.col("op"), F.col("provider"), F.col("model"), F.col("fact_key"), F.col("value"))
    return o.select(*KEYS, "release", line.alias("line"), value_hash(F.coalesce("value", F.lit("null"))).alias("value_hash"))


@query("release_change_hashes", f"""WITH {_STATES} SELECT release, sha256('{{"curation_set":' || CASE WHEN release % 2 = 0 THEN '{{"a":1e+7,"version":' || release || '}}' ELSE 'null' END || ',"upstream":[' || string_agg(line, ',' ORDER BY provider, model NULLS FIRST, fact_key) || ']}}') AS change_hash FROM lines GROUP BY release""")
def _(s, d):
    o = change_ops(s, d)
    r = F.col("release")
    curation = F.when(r % 2 == 0, F.concat(F.lit('{ "version" : '), r.cast("string"), F.lit(', "a": 1E7}')))
    heads = o.groupBy("release").agg(F.count(F.lit(1)).alias("n_ops")).withColumn("curation_set", curation)
    return releases.change_hashes(heads, o)


@query("publish_round_trip", f"WITH {_STATES} SELECT provider, model, fact_key, v AS value_json FROM new")
def _(s, d):
    """The first state, with all ops between the two applied, is the second one."""
    old, _ = two_states(s, d)
    o = change_ops(s, d)
    return diff.replay_chain(old, o, KEYS, ["release", "pos"])


@query("replay_release", f"""WITH {_STATES}, bad AS (SELECT provider, model, fact_key, op, v FROM ops UNION ALL SELECT provider, model, 'never', 'remove', NULL FROM ops WHERE fact_key = 'segment' AND model::BIGINT % 10 = 1
UNION ALL SELECT n_nationkey::VARCHAR || 'x', NULL, 'provider.name', 'set_provider', '1' FROM nation UNION ALL SELECT n_nationkey::VARCHAR, NULL, 'provider.odd', 'rename', NULL FROM nation WHERE n_nationkey % 5 = 0)
SELECT provider, model, fact_key, 'removes_nothing' AS violation FROM bad WHERE fact_key = 'never' UNION ALL SELECT n_nationkey::VARCHAR || 'x', NULL, x.f, x.v FROM nation, (VALUES ('provider.name', 'unknown_provider'), (NULL, 'orphan_provider_facts')) x(f, v) UNION ALL SELECT n_nationkey::VARCHAR, NULL, 'provider.odd', 'unknown_op' FROM nation WHERE n_nationkey % 5 = 0""")
def _(s, d):
    """What is refused of a change that also removes what isn't there, names providers that nobody knows and has ops of its own invention."""
    old, _ = two_states(s, d)
    o = change_ops(s, d).select(*KEYS, "op", "value")
    n, none = table(s, d, "nation"), F.lit(None).cast("string")
    absent = o.where("fact_key = 'segment' AND CAST(model AS LONG) % 10 = 1").select("provider", "model", F.lit("never").alias("fact_key"), F.lit("remove").alias("op"), none.alias("value"))
    k = F.col("n_nationkey").cast("string")
    unknown = n.select(F.concat(k, F.lit("x")).alias("provider"), none.alias("model"), F.lit("provider.name").alias("fact_key"), F.lit("set_provider").alias("op"), F.lit("1").alias("value"))
    odd = n.where("n_nationkey % 5 = 0").select(k.alias("provider"), none.alias("model"), F.lit("provider.odd").alias("fact_key"), F.lit("rename").alias("op"), none.alias("value"))
    return diff.replay_change(old, o.unionByName(absent).unionByName(unknown).unionByName(odd), KEYS)[1]


@query("envelope_violations", """WITH r AS (SELECT s_suppkey AS release FROM supplier) SELECT release, 'parent' AS violation FROM r WHERE release % 6 = 0 UNION ALL SELECT release, 'state_hash' FROM r WHERE release % 4 = 0 UNION ALL SELECT release, 'change_hash' FROM r WHERE release % 5 = 0""")
def _(s, d):
    r = F.col("release")
    heads = table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("release"), F.md5("s_name").alias("curation_hash"), F.md5(F.concat("s_name", F.lit("x"))).alias("upstream_hash"))
    heads = heads.withColumn("parent", F.when(r % 6 == 0, r).when(r > 1, r - 1)).withColumn("state_hash", F.when(r % 4 == 0, F.lit("other")).otherwise(diff.state_hash(F.col("curation_hash"), F.col("upstream_hash"))))
    heads = heads.withColumn("curation_set", F.lit(None).cast("string")).withColumn("n_ops", F.lit(1))
    ops = heads.select("release", F.lit(0).alias("pos"), F.lit("set").alias("op"), F.lit("p").alias("provider"), r.cast("string").alias("model"), F.lit("f").alias("fact_key"), F.lit("1").alias("value"))
    text = F.concat(F.lit('{"curation_set":null,"upstream":[{"fact":"f","model":"'), r.cast("string"), F.lit('","op":"set","provider":"p","value":1}]}'))
    heads = heads.withColumn("change_hash", F.when(r % 5 == 0, F.lit("other")).otherwise(F.sha2(text, 256)))
    return releases.check_envelopes(heads, releases.change_hashes(heads, ops))


@query("page_plan", """WITH RECURSIVE s AS (SELECT s_name AS provider, 50 + s_suppkey * 37 % 400 AS bytes, row_number() OVER (ORDER BY s_name) AS i, count(*) OVER () AS n FROM supplier),
t AS (SELECT provider, bytes, i, CASE WHEN i = n THEN 0 ELSE 9 + strlen(provider) END AS e FROM s),
p AS (SELECT provider, bytes, i, 0::BIGINT AS page, 20 + bytes AS used, e FROM t WHERE i = 1
UNION ALL SELECT t.provider, t.bytes, t.i, CASE WHEN p.used + p.e > 500 OR p.used + t.bytes + t.e > 500 THEN p.page + 1 ELSE p.page END, CASE WHEN p.used + p.e > 500 OR p.used + t.bytes + t.e > 500 THEN 20 + t.bytes ELSE p.used + t.bytes END, t.e FROM p JOIN t ON t.i = p.i + 1)
SELECT provider, bytes, page, used + e AS page_bytes FROM p""")
def _(s, d):
    """Whole suppliers on pages of 500 bytes."""
    from factledger.sources.documents import page_plan

    profile = table(s, d, "supplier").select(F.col("s_name").alias("provider"), (F.lit(50) + F.col("s_suppkey") * 37 % 400).alias("bytes"))
    return page_plan(profile, 500, envelope=20, token=9)
