"""Digests are streamed and equal those of the collected form; the curation set comes as rows."""

import hashlib

from pyspark.sql import functions as F

from factledger.operators import diff, reports


def test_digests_stream(spark):
    rows = [(None if e == 0 else e, str(k), None if k % 7 == 0 else "v" * (k % 5)) for e in range(6) for k in range(50 * (e + 1))] + [(9, None, "x")]
    facts = spark.createDataFrame(rows, "e long, fact_key string, value_json string").repartition(5)
    got = diff.facts_digest(facts, ["e"])
    want = {}
    for e, k, v in rows:
        part = None if k is None else f"{len(k)}:{k}" + ("-" if v is None else f"{len(v)}:{v}")
        want.setdefault(e, []).extend([] if part is None else [hashlib.sha256(part.encode()).hexdigest()])
    assert {r["e"]: r["digest"] for r in got.collect()} == {e: hashlib.sha256("".join(sorted(x)).encode()).hexdigest() for e, x in want.items()}
    old = got.groupBy(F.pmod(F.xxhash64("e"), F.lit(4)).alias("slice")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.to_json(F.struct("e", "digest")), 256))), ""), 256).alias("digest"))
    old = old.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "slice", "digest"))), ""), 256).alias("digest"))
    assert diff.state_digest(got, ["e"], 4).collect() == old.collect()
    assert diff.facts_digest(facts.limit(0), ["e"]).count() == 0
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_curation_rows(spark):
    j = spark.createDataFrame([("g", "a", "1", 1, 0, 5), ("g", "a", "2", 2, 0, 6), ("g", "b", "3", 3, 1, 7)], "kind string, key string, value string, id long, withdrawn int, recorded_at_ms long")
    d = spark.createDataFrame([("r", "k", "9", 4, 1), ("r", "c", "8", 3, 2)], "kind string, key string, value string, boundary long, id long")
    entries, approved = reports.curation_rows(j, d)
    assert [tuple(r) for r in entries.collect()] == [("g", "a", "2"), ("r", "c", "8"), ("r", "k", "9")]
    assert {tuple(r) for r in approved.collect()} == {("g", 6), ("r", 4)}
