"""Queries over the tree of digests: orders as facts of their customers, and the same with some values changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators import ranges
from factledger.plans.queries import query, table

KEYS, DIGITS = ["customer", "fact_key"], 2


def states(s, d) -> tuple[DataFrame, DataFrame]:
    """Each order's status before and after: every thousandth order changes, some go and some come."""
    k = F.col("o_orderkey")
    o = table(s, d, "orders").groupBy("o_orderkey", "o_custkey").agg(F.max("o_orderstatus").alias("v"))
    fact = lambda rows, v: rows.select(F.col("o_custkey").cast("string").alias("customer"), F.concat(F.lit("order."), k.cast("string")).alias("fact_key"), v.alias("value_json"))
    return fact(o.where(k % 997 != 1), F.col("v")), fact(o.where(k % 991 != 2), F.when(k % 1000 == 3, "changed").otherwise(F.col("v")))


_SPELL = "length(customer) || ':' || customer || length(fact_key) || ':' || fact_key"
_STATES = f"""o AS (SELECT o_orderkey AS k, o_custkey::VARCHAR AS customer, 'order.' || o_orderkey AS fact_key, max(o_orderstatus) AS v FROM orders GROUP BY 1, 2, 3),
a AS (SELECT customer, fact_key, v FROM o WHERE k % 997 <> 1), b AS (SELECT customer, fact_key, CASE WHEN k % 1000 = 3 THEN 'changed' ELSE v END AS v FROM o WHERE k % 991 <> 2),
l2 AS (SELECT left(sha256({_SPELL}), 2) AS r, count(*) AS facts, sha256(string_agg(sha256({_SPELL} || length(v) || ':' || v), '' ORDER BY sha256({_SPELL} || length(v) || ':' || v))) AS digest FROM a GROUP BY 1),
l1 AS (SELECT left(r, 1) AS r, sum(facts)::BIGINT AS facts, sha256(string_agg(r || ':' || digest, ',' ORDER BY r)) AS digest FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS r, sum(facts)::BIGINT AS facts, sha256(string_agg(r || ':' || digest, ',' ORDER BY r)) AS digest FROM l1)"""


@query("range_tree", f'WITH {_STATES} SELECT r AS "range", facts, digest FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0')
def _(s, d):
    return ranges.fold_ranges(ranges.range_digests(states(s, d)[0], KEYS, digits=DIGITS), DIGITS)


@query("ranged_diff", f"WITH {_STATES} SELECT coalesce(a.customer, b.customer) AS customer, coalesce(a.fact_key, b.fact_key) AS fact_key, a.v AS old_value, b.v AS new_value, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.customer = b.customer AND a.fact_key = b.fact_key WHERE a.v IS DISTINCT FROM b.v")
def _(s, d):
    """Found through the ranges whose digests differ."""
    old, new = states(s, d)
    changed = ranges.changed_ranges(ranges.range_digests(old, KEYS, digits=DIGITS), ranges.range_digests(new, KEYS, digits=DIGITS), DIGITS)
    return ranges.ranged_diff(ranges.with_range(old, KEYS, DIGITS), ranges.with_range(new, KEYS, DIGITS), changed, KEYS)
