"""The tree of digests against a plain one, and what a poll with one change reads."""

import hashlib

from pyspark.sql import functions as F

from factledger.operators import ranges
from factledger.operators.diff import diff_keyed

S, KEYS = "provider string, model string, fact_key string, value_json string", ["provider", "model", "fact_key"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(rows, digits):
    spell = lambda *c: "".join("-" if x is None else f"{len(x)}:{x}" for x in c)
    level, out = {}, {}
    for r in rows:
        level.setdefault(sha(spell(*r[:3]))[:digits], []).append(sha(spell(*r)))
    level = {k: (len(v), sha("".join(sorted(v)))) for k, v in level.items()}
    out.update(level)
    for n in range(digits - 1, -1, -1):
        up = {}
        for k, (c, h) in sorted(level.items()):
            up.setdefault(k[:n], []).append((c, f"{k}:{h}"))
        level = {k: (sum(c for c, _ in v), sha(",".join(h for _, h in v))) for k, v in up.items()}
        out.update(level)
    return out


def test_tree_and_diff(spark, tmp_path):
    rows = [(f"p{i % 3}", None if i % 50 == 0 else f"m{i}", f"f{i}", None if i % 7 == 0 else str(i)) for i in range(400)] + [("", "1:a", "f", ""), ("é", "b", "f", "ü")]
    old = spark.createDataFrame(rows, S).repartition(5)
    tree = ranges.fold_ranges(ranges.range_digests(old, KEYS, digits=3), 3).cache()
    assert {r["range"]: (r["facts"], r["digest"]) for r in tree.collect()} == plain_tree(rows, 3)
    again = ranges.fold_ranges(ranges.range_digests(old.repartition(2), KEYS, digits=3), 3)
    assert ranges.same_root(tree, again) and ranges.changed_ranges(tree, again, 3).count() == 0
    new = old.where("model IS NULL OR model <> 'm7'").withColumn("value_json", F.when(F.col("model") == "m9", "9!").otherwise(F.col("value_json")))
    other = ranges.fold_ranges(ranges.range_digests(new, KEYS, digits=3), 3)
    changed = ranges.changed_ranges(tree, other, 3)
    assert not ranges.same_root(tree, other) and changed.count() == 2
    kept, got = [], None
    for name, df in (("a", old), ("b", new)):
        ranges.with_range(df, KEYS, 3).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    for most in (1000, 1):
        got = ranges.ranged_diff(*kept, changed, KEYS, most=most)
        assert sorted(map(str, got.collect())) == sorted(map(str, diff_keyed(old, new, KEYS, "value_json").collect())) and got.count() == 2
    plan = ranges.ranged_diff(*kept, changed, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [In(range") == 2
    nothing = ranges.fold_ranges(ranges.range_digests(old.limit(0), KEYS, digits=3), 3)
    assert nothing.where("digest IS NOT NULL AND range <> ''").count() == 0 and not ranges.same_root(nothing, tree)
    assert [ranges.digits_for(n) for n in (0, 16_000, 16_001, 10**9)] == [1, 1, 2, 5]
