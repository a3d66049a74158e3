"""Files in and out: releases, histories, day folders, directories; and the monitor of a feed."""

import json

import pytest
from pyspark.sql import functions as F

from factledger.operators import judged, ledger
from factledger.plans.view import Plane, Rules, served_view
from factledger.sources import documents, tables

OPS = "release long, pos int, published_at_ms long, provider string, model string, fact_key string, op string, value string"
DAY = 86_400_000


def test_releases_are_read_in_order(spark, tmp_path):
    for r in (1, 2):
        ops = [{"op": "set", "provider": "p", "model": "m", "fact": f"f{i}", "value": str(i)} for i in range(2)] + [{"op": "remove_provider", "provider": "p", "fact": "provider.name"}]
        head = {"release": r, "parent": r - 1 or None, "published_at_ms": r * 10} | dict.fromkeys(("upstream_observed_at_ms", "upstream_hash", "curation_version", "curation_hash", "state_hash", "change_hash"))
        (tmp_path / f"{r}.json").write_text(json.dumps({"envelope": head, "change": {"curation_set": None, "upstream": ops}}, indent=1))
    got = documents.read_releases(spark, str(tmp_path)).orderBy("release", "pos").collect()
    assert [(r["release"], r["parent"], r["pos"], r["op"], r["model"], r["fact_key"], r["value"]) for r in got[:3]] == [(1, None, 0, "set", "m", "f0", '"0"'), (1, None, 1, "set", "m", "f1", '"1"'), (1, None, 2, "remove_provider", None, "provider.name", None)]
    assert len(got) == 6 and got[5]["published_at_ms"] == 20


def test_history_goes_only_into_an_empty_table_with_rising_ids(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (1, 5, "b"), (2, 9, "c")], "pos long, id long, v string")
    assert [r["id"] for r in tables.import_history(rows, "id LONG, v STRING", True).orderBy("id").collect()] == [1, 5, 9]
    for bad, empty, schema in ((rows, False, "id LONG, v STRING"), (rows, True, "id LONG, w STRING"), (rows.withColumn("id", -F.col("id")), True, "id LONG, v STRING"), (rows.withColumn("pos", F.col("pos") * -1_000_000), True, "id LONG, v STRING")):
        with pytest.raises(ValueError):
            tables.import_history(bad, schema, empty)


def test_an_export_holds_no_home_folder(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id long, v string")
    assert tables.export_history(rows, str(tmp_path / "h")) == 2 and [r["id"] for r in spark.read.parquet(str(tmp_path / "h")).orderBy("id").collect()] == [1, 2]
    with pytest.raises(ValueError, match="home folder"):
        tables.export_history(rows.withColumn("v", F.lit("see /home/someone/x")), str(tmp_path / "i"))


def test_days_of_history(spark, tmp_path):
    ops = spark.createDataFrame([(0, 0, 0, "p", "m", "f", "set", "1"), (1, 0, 5, "p", "m", "f", "set", "2"), (1, 1, 5, "p", "m", "g", "set", "2"), (2, 0, DAY - 1, "p", "m", "f", "set", "3"), (3, 0, DAY, "p", "m", "f", "set", "4")], OPS)
    tables.history_days(ops, str(tmp_path / "d"), days=2)
    got = spark.read.parquet(str(tmp_path / "d"))
    assert {(str(r["day"]), r["release"]) for r in got.collect()} == {("1970-01-01", 1), ("1970-01-01", 2), ("1970-01-02", 3)} and got.count() == 4  # the import is left out
    with pytest.raises(ValueError, match="missing"):
        tables.history_days(ops.where("release <> 2"), str(tmp_path / "e"))
    with pytest.raises(ValueError, match="empty"):
        tables.history_days(ops, str(tmp_path / "f"), days=3)


def test_the_directory_of_providers(spark):
    up = spark.createDataFrame([("p", "P", "d", ["text"], ["KEY"], "chat"), ("p", "P", "d", ["image", "text"], ["KEY"], None), ("p", "P", "d", None, ["KEY"], "embedding")], "provider string, name string, doc string, modalities array<string>, env array<string>, type string")
    kept = spark.createDataFrame([("q", "Q", None, ["text"], None)], "provider string, name string, doc string, modalities array<string>, env array<string>")
    got = {r["provider"]: (r["modalities"], r["env"]) for r in documents.provider_directory(up, kept).collect()}
    assert got == {"p": (["embedding", "image", "text"], ["KEY"]), "q": (["text"], None)}
    with pytest.raises(Exception, match="clashes"):
        documents.provider_directory(up, kept.withColumn("provider", F.lit("p"))).collect()


def test_the_monitor_of_a_feed(spark):
    s = "id long, source string, observed_at_ms long, outcome string, failure_class string"
    hour = 3_600_000
    rows = [(1, "fresh", 100 * hour - 1, "changed", None), (2, "stale", 97 * hour, "unchanged", None), (3, "stale", 100 * hour - 5, "failed", "network"), (4, "silent", 90 * hour, "changed", None)]
    rows += [(10 + i, "failing", 100 * hour - 10 + i, "failed", "parse") for i in range(4)] + [(20, "unrecorded", 99 * hour, "changed", None), (21, "unrecorded", 100 * hour - 3, "unrecorded", None), (22, "unrecorded", 100 * hour - 2, "unrecorded", None)]
    got = {r["source"]: r["status"] for r in ledger.freshness(spark.createDataFrame(rows, s), 100 * hour, ["source"]).collect()}
    assert got == {n: n for n in ("fresh", "stale", "silent", "failing", "unrecorded")}
    assert [r["id"] for r in ledger.read_observations(spark.createDataFrame(rows, s), since=99 * hour, n=2).collect()] == [1, 22]


def test_from_a_document_to_a_view(spark, tmp_path):
    """One path: a nested document, facts, eras, and a view with efforts, limits and a label that are not empty."""
    from factledger.operators.diff import plan_ingest
    from factledger.operators.reports import provider_labels

    (tmp_path / "d.json").write_text(json.dumps({"p": {"name": "The P", "npm": "kit", "models": {"m": {"canonical_model_id": "lab/m", "limit": {"context": 10}, "modalities": {"input": ["image"]}, "reasoning_options": [{"type": "effort", "values": ["low"]}], "cost": {"input": 1}}}}}))
    facts = documents.to_facts(documents.normalise_models(documents.read_documents(spark, str(tmp_path))))
    eras = plan_ingest(facts.limit(0), facts, ["provider", "model"]).select("provider", "model", "fact_key", "value_json", F.lit(1).cast("long").alias("boundary"), F.lit(1).cast("long").alias("id"), F.lit(None).cast("long").alias("prior_ms"))
    graded = spark.createDataFrame([("lab/m", "low", 5)], "key string, effort string, recorded_at_ms long")
    limits = spark.createDataFrame([("p", "limit.image_bytes", "image", "fixed", 3, None, None, None)], "provider string, fact_key string, modality string, kind string, value long, at long, other long, conditions array<struct<above long, value long>>")
    rules_ = spark.createDataFrame([("p", "output", "stated_zero", None, None)], "provider string, class string, action string, target string, model_ids array<string>")
    v = served_view(eras, Rules(judgments=judged.judgments(None, None, graded), limits=limits, plane_rules=rules_), plane=Plane("p", "oauth"))
    got = {r["fact_key"]: r["value_json"] for r in v.facts.collect()}
    assert got["quality.graded_effort"] == '"low"' and got["limit.image_bytes"] == "3" and got["rate.output"] == '{"state":"stated_zero"}' and got["provider.name"] == '"The P"'
    none = spark.createDataFrame([], "provider string, model string, fact_key string, from_ms long, until_ms long")
    assert [tuple(r) for r in provider_labels(eras, none, 5).collect()] == [("p", "The P")]


def test_pages_of_whole_providers(spark):
    """Against a loop, from the start and from any cursor."""
    import random

    r = random.Random(3)
    sizes = {f"p{i:02d}{'é' * (i % 3)}": r.choice([5, 10, 30, 99, 100, 101, 250]) for i in range(60)}
    profile = spark.createDataFrame([*sizes.items(), (None, 5)], "provider string, bytes long").repartition(4)

    def by_hand(names, limit, envelope, token):
        out, at, page = [], 0, 0
        while at < len(names):
            used, k = envelope, at
            while k < len(names):
                end = token + len(names[k].encode()) if k + 1 < len(names) else 0
                if k > at and used + sizes[names[k]] + end > limit:
                    break
                used += sizes[names[k]]
                out.append((names[k], sizes[names[k]], page, used + end))
                k += 1
                if used + end > limit:
                    break
            at, page = k, page + 1
        return out

    names = sorted(sizes, key=str.encode)
    for limit, envelope, token in ((200, 0, 0), (200, 17, 9), (50, 1, 1), (10**6, 5, 5)):
        for after in (None, names[10], names[-1]):
            got = [tuple(x) for x in documents.page_plan(profile, limit, envelope=envelope, token=token, after=after).collect()]
            assert got == by_hand([n for n in names if after is None or n.encode() > after.encode()], limit, envelope, token)
