"""Queries over rule tables that hold mistakes: repeated keys, chains, rows that fail by themselves. Suppliers are their rows, in the order of their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.operators import rules
from factledger.plans.queries import query, table

REVIEW = 60 * 86_400_000


def _k() -> Column:
    return F.col("s_suppkey").cast("long")


def _rows(s, d, **columns: Column) -> DataFrame:
    said = {"source_ref": F.lit("https://x"), "quote": F.lit("q"), "established_at_ms": F.lit(1).cast("long"), "review_by_ms": F.lit(1 + REVIEW).cast("long")}
    return table(s, d, "supplier").select(_k().alias("pos"), *[v.alias(k) for k, v in (said | columns).items()])


def _pick(*cases: Column | str) -> Column:
    """By the last digit of the row's number; text is followed by the number of the ten that it belongs to."""
    made = [F.concat(F.lit(x), F.floor(_k() / 10).cast("string")) if isinstance(x, str) else x for x in cases]
    return reduce(lambda c, x: c.when(_k() % 10 == x[0], x[1]), list(enumerate(made))[1:], F.when(_k() % 10 == 0, made[0]))


def tables(s, d) -> dict[str, DataFrame]:
    p, none = F.lit("p"), F.lit(None).cast("string")
    return {
        "aliases": _rows(s, d, provider=p, model=_pick("a", "a", "x", "y", "z", "s", "s", "t", "u", "v"), target_provider=p, target=_pick("r", "r", F.lit(" "), "x", "a", "s", "r", "r", "r", "r"), basis=F.lit("b"), output_limit=F.lit(None).cast("long"), default_effort=none, wire_ids=F.lit(None).cast("map<string,string>")),
        "speed_twins": _rows(s, d, provider=p, base=_pick("b", "b", "c", "c", "d", "d", "e", "k", "f", "g"), twin=_pick("t", "u", "t", "v", "v", "w", "d", "l", "e", "h"), mode=F.when(_k() % 10 == 4, "slow").otherwise("fast"), label=F.lit("l"), api_card=F.when(_k() % 10 == 7, "p/x y/z").otherwise("p/c")),
        "creators": _rows(s, d, family=F.concat(F.lit("f"), F.floor(_k() / 3).cast("string")), creator=F.when(_k() % 7 == 0, "").otherwise(_k().cast("string"))),
        "temperature_ranges": _rows(s, d, provider=F.concat(F.lit("p"), F.floor(_k() / 4).cast("string")), low=F.when(_k() % 5 == 0, 3).otherwise(0), high=F.lit(2)),
        "wire_families": _rows(s, d, npm=F.concat(F.lit("n"), F.floor(_k() / 2).cast("string")), shape=F.lit("x"), family=F.lit("f"), basis=F.when(_k() % 4 == 0, "guess").otherwise("docs")),
        "login_methods": _rows(s, d, provider=p, model=F.concat(F.lit("m"), F.floor(_k() / 2).cast("string")), methods=F.when(_k() % 6 == 0, F.array(F.lit("sms"))).otherwise(F.array(F.lit("oauth")))),
        "held_models": _rows(s, d, provider=p, model=F.concat(F.lit("m"), F.floor(_k() / 2).cast("string")), reason=F.when(_k() % 4 == 0, "").otherwise("r"), held_since_ms=F.lit(1).cast("long")),
        "lineage": _rows(s, d, kind=F.when(_k() % 5 == 0, "tribe").otherwise("family"), key=F.concat(F.lit("k"), F.floor(_k() / 2).cast("string")), purpose=F.lit("p"), **{"class": F.when(_k() % 9 == 0, "odd").otherwise("known")}),
    }


def _duplicates(kind: str, per: int, bad: str, reason: str, more: str = "") -> str:
    """Rejects of a table whose keys are shared by `per` rows in a row: those that fail (bad), and of the others all but the first."""
    return f"SELECT '{kind}' AS kind, k AS pos, {reason} AS reasons FROM s WHERE {bad} UNION ALL SELECT '{kind}', k, 'duplicate_key' FROM (SELECT k, row_number() OVER (PARTITION BY k // {per} ORDER BY k{more}) AS n FROM s WHERE NOT ({bad})) WHERE n > 1"


@query("spec_rejects", f"""WITH s AS (SELECT s_suppkey AS k FROM supplier), t AS (SELECT * FROM (VALUES ('aliases', 1, 'duplicate_key'), ('aliases', 2, 'empty_target'), ('aliases', 4, 'chained_target'), ('aliases', 5, 'self_target'),
 ('speed_twins', 1, 'duplicate_key'), ('speed_twins', 2, 'duplicate_twin'), ('speed_twins', 4, 'unknown_mode'), ('speed_twins', 6, 'twin_is_base'), ('speed_twins', 7, 'api_card'), ('speed_twins', 8, 'twin_is_base')) t(kind, i, reasons))
SELECT kind, k AS pos, reasons FROM s JOIN t ON k % 10 = i
UNION ALL {_duplicates('creators', 3, "k % 7 = 0", "'empty_creator'", " DESC")} UNION ALL {_duplicates('temperature_ranges', 4, "k % 5 = 0", "'backwards'")} UNION ALL {_duplicates('wire_families', 2, "k % 4 = 0", "'unknown_basis'")}
UNION ALL {_duplicates('login_methods', 2, "k % 6 = 0", "'unknown_method'")} UNION ALL {_duplicates('held_models', 2, "k % 4 = 0 OR k // 2 % 5 = 0", "concat_ws(',', CASE WHEN k % 4 = 0 THEN 'empty_reason' END, CASE WHEN k // 2 % 5 = 0 THEN 'no_curated_row' END)")}
UNION ALL {_duplicates('lineage', 2, "k % 5 = 0 OR k % 9 = 0", "concat_ws(',', CASE WHEN k % 5 = 0 THEN 'unknown_kind' END, CASE WHEN k % 9 = 0 THEN 'unknown_class' END)")}""")
def _(s, d):
    """Rejects of eight rule tables with repeats, chains and rows that fail by themselves."""
    specs, rejects = rules.specs(), []
    given = tables(s, d)
    curated = given["held_models"].where(F.floor(F.col("pos") / 2) % 5 != 0).select("provider", "model")
    context = {"curated": curated, "lineages": s.createDataFrame([("known",)], "class string")}
    for kind, rows in given.items():
        mine = context if kind in ("held_models", "lineage") else None
        bad = rules.load_rules(rows, specs[kind], mine)[1]
        rejects.append(bad.select(F.lit(kind).alias("kind"), "pos", F.array_join("reasons", ",").alias("reasons")))
    return reduce(DataFrame.unionByName, rejects)


@query("table_invariants", """WITH c AS (SELECT c_custkey AS k FROM customer), v AS (
SELECT 'price' AS tbl, unnest(list_filter([CASE WHEN k % 17 = 0 THEN 'required' END, CASE WHEN k % 19 = 0 THEN 'kind' END, CASE WHEN k % 6 = 5 THEN 'price_or_refusal' END, CASE WHEN k % 6 = 4 THEN 'price_parts' END], lambda x: x IS NOT NULL)) AS violation FROM c
UNION ALL SELECT 'curated', unnest(list_filter([CASE WHEN k % 17 = 0 THEN 'required' END, CASE WHEN k % 5 = 3 THEN 'tombstone' END, CASE WHEN k % 5 = 4 THEN 'auth_methods' END, CASE WHEN k % 5 = 4 THEN 'review' END], lambda x: x IS NOT NULL)) FROM c
UNION ALL SELECT 'override', unnest(list_filter([CASE WHEN k % 17 = 0 THEN 'required' END, CASE WHEN k % 5 = 3 THEN 'reason' END, CASE WHEN k % 5 = 4 THEN 'leftover' END], lambda x: x IS NOT NULL)) FROM c
UNION ALL SELECT 'judgment', unnest(list_filter([CASE WHEN k % 17 = 0 THEN 'required' END, CASE WHEN k % 6 = 3 THEN 'withdrawn' END, CASE WHEN k % 6 = 4 THEN 'kind' END, CASE WHEN k % 6 IN (3, 5) THEN 'shape' END], lambda x: x IS NOT NULL)) FROM c)
SELECT tbl, violation, count(*) AS n FROM v GROUP BY 1, 2""")
def _(s, d):
    """Violations of four tables, planted by the customer's number."""
    from factledger.operators import ledger

    c, k = table(s, d, "customer"), F.col("c_custkey")
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    ids = [F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("f").alias("fact_key"), F.lit("t").alias("tier"), one.alias("boundary"), F.when(k % 17 != 0, "https://x").alias("source_ref"), F.lit("us").alias("established_by"), one.alias("established_at_ms"), one.alias("recorded_at_ms")]
    said = lambda test, value: F.when(test, F.lit(value))
    m = k % 6
    price = c.select(*ids, F.when(k % 19 == 0, "observed").otherwise("asserted").alias("kind"), F.when(m != 1, one).alias("minor_units"), said(m.isin(1, 5), "r").alias("refusal_reason"), F.when(m != 4, one).alias("exponent"), F.lit("USD").alias("currency"), F.lit("month").alias("period"), one.alias("review_by_ms"))
    m = k % 5
    curated = c.select(*ids, said(m != 1, "{}").alias("facts_json"), said(m.isin(1, 3), "gone").alias("tombstone_reason"), said(~m.isin(1, 4), "[]").alias("auth_methods_json"), F.when(~m.isin(1, 4), one).alias("review_by_ms"))
    live = ~m.isin(1, 4)
    override = c.select(*ids, said(live, "1").alias("value_json"), said(~live, "gone").alias("tombstone_reason"), said(live & (m != 3), "r").alias("reason"), said(live, "q").alias("quote"), F.when(live, one).alias("review_by_ms"), said(m == 4, "2").alias("replaces_json"), said(m == 2, "n").alias("notes"))
    m = k % 6
    judgment = c.select(F.lit("m").alias("model"), F.when(k % 17 != 0, "us").alias("graded_by"), F.lit("r").alias("reason"), one.alias("recorded_at_ms"), F.when(m == 3, 2).when(m == 1, 1).otherwise(0).alias("withdrawn"), F.when(m.isin(0, 3, 5), one).alias("elo"), F.when(m.isin(0, 3), one).alias("eq"), F.when(m.isin(2, 4), one).otherwise(none).alias("grade"), F.when(m == 2, "image").when(m == 4, "smell").alias("kind"))
    parts = {"price": (price, ledger.price_rules()), "curated": (curated, ledger.curated_rules()), "override": (override, ledger.override_rules()), "judgment": (judgment, ledger.judgment_rules())}
    found = [ledger.check_invariants(df, checks).select(F.lit(name).alias("tbl"), "violation") for name, (df, checks) in parts.items()]
    return reduce(DataFrame.unionByName, found).groupBy("tbl", "violation").agg(F.count(F.lit(1)).alias("n"))
