"""Release files: canonical JSON, the two levels of a change, envelopes, and files that are no releases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factledger.functions.canonical import canonical_json, canonical_text
from factledger.operators import diff
from factledger.sources import documents, releases

S = "provider string, model string, fact_key string, value_json string"
KEYS = ["provider", "model", "fact_key"]
OPS = [
    {"op": "set_provider", "provider": "a", "fact": "provider.name", "value": "Läb \"x\"\u0001"}, {"op": "remove_provider", "provider": "a", "fact": "provider.old"},
    {"op": "set", "provider": "a", "model": "-", "fact": "rate", "value": {"z": 1, "currency": "USD", "exponent": -9}}, {"op": "set", "provider": "a", "model": "-", "fact": "text", "value": "null"},
    {"op": "set", "provider": "a", "model": "m", "fact": "none", "value": None}, {"op": "remove", "provider": "b", "model": "m", "fact": "gone"},
]


def text_of(change, release=2, parent=1, curation=None):
    body = {"curation_set": curation, "upstream": change}
    plain = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = {"release": release, "parent": parent, "published_at_ms": 10 * release, "upstream_observed_at_ms": 9 * release, "upstream_hash": sha("u"), "curation_version": 1, "curation_hash": sha("c"), "state_hash": sha(f'{{"curation":"{sha("c")}","upstream":"{sha("u")}"}}'), "change_hash": sha(plain), "format": "f/v1"}
    return json.dumps({"envelope": head, "change": body, "signatures": {"kid": "k"}}, indent=1)


def test_canonical_json(spark):
    said = {
        ' { "é": "\\u96ea\\/", "z": {"n": 1E7, "c": "\\u0000\\t\\u001f\\u007f"}, "a": [0.30000000000000004, 1e-7, -0, 1.00, -0.0] } ': '{"a":[0.30000000000000004,1e-7,0,1.00,-0.0],"z":{"c":"\\u0000\\t\\u001f\x7f","n":1e+7},"é":"雪/"}',
        "null": "null", " true": "true", '"\\u00e9\\b\\f"': '"é\\b\\f"', "12345678901234567890123456789": "12345678901234567890123456789", "[]": "[]", '{"b":{},"a":[]}': '{"a":[],"b":{}}',
    }
    assert {k: canonical_text(k) for k in said} == said
    df = spark.createDataFrame([(k,) for k in [*said, None]], "v string")
    assert [r[0] for r in df.select(canonical_json(F.col("v"))).collect()] == [*said.values(), None]
    for bad in ("", "NaN", "{", "{'a':1}"):
        with pytest.raises(ValueError):
            canonical_text(bad)


def test_files_are_read_checked_and_written_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(text_of([], 1, None, {"version": 1, "n": 3}))
    (tmp_path / "in" / "2.json").write_text(text_of(OPS))
    rows = releases.read_release_files(spark, str(tmp_path / "in")).cache()
    heads, ops = releases.envelopes(rows), releases.ops(rows)
    got = ops.orderBy("pos").collect()
    assert [(r["op"], r["provider"], r["model"], r["fact_key"]) for r in got] == [(o["op"], o["provider"], o.get("model"), o["fact"]) for o in OPS]
    assert [r["value"] for r in got] == ['"Läb \\"x\\"\\u0001"', None, '{"currency":"USD","exponent":-9,"z":1}', '"null"', "null", None]
    assert documents.read_releases(spark, str(tmp_path / "in")).count() == 6
    assert [(r["release"], r["parent"], r["curation_set"], r["n_ops"]) for r in heads.orderBy("release").collect()] == [(1, None, '{"n":3,"version":1}', 0), (2, 1, None, 6)]
    assert releases.check_envelopes(heads, releases.change_hashes(heads, ops)).count() == 0
    bad = heads.withColumn("change_hash", F.lit("0")).withColumn("parent", F.lit(7).cast("long")).withColumn("curation_hash", F.lit("x"))
    assert sorted(r["violation"] for r in releases.check_envelopes(bad, releases.change_hashes(heads, ops)).where("release = 2").collect()) == ["change_hash", "parent", "state_hash"]
    releases.write_releases(heads, ops, str(tmp_path / "out"), F.lit('{"kid":"k"}'))
    for n in (1, 2):
        files = [p for p in (tmp_path / "out" / f"release={n}").iterdir() if p.name.startswith("part")]
        want = json.loads((tmp_path / "in" / f"{n}.json").read_text())
        want["envelope"].pop("format")
        assert len(files) == 1 and json.loads(files[0].read_text()) == want
    again = releases.read_release_files(spark, str(tmp_path / "out" / "release=*"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


@pytest.mark.parametrize("op", [{"op": "rename", "provider": "a", "fact": "f"}, {"op": "set", "provider": "a", "fact": "f", "value": 1}, {"op": "set_provider", "provider": "a", "fact": "f"}, {"op": "remove", "provider": "a", "model": 3, "fact": "f"}])
def test_files_that_are_no_releases_stop_the_job(spark, tmp_path, op):
    (tmp_path / "2.json").write_text(text_of([op]))
    with pytest.raises(Exception, match="2.json is no release"):
        releases.read_release_files(spark, str(tmp_path)).count()


def test_flat_files_stop_the_job(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"release": 1, "parent": None, "published_at_ms": 1, "upstream": []}))
    with pytest.raises(Exception, match="no release"):
        documents.read_releases(spark, str(tmp_path)).count()


def test_a_snapshot_is_read_on_both_levels(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"envelope": {}, "state": {"upstream": {"a": {"provider": {"provider.name": "A"}, "models": {"-": {"existence": "present", "r": {"b": 1, "a": None}}}}, "b": {"provider": {}, "models": {"m": {"n": 1}}}}}}))
    got = sorted(map(tuple, releases.read_state(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("a", None, "provider.name", '"A"'), ("a", "-", "existence", '"present"'), ("a", "-", "r", '{"a":null,"b":1}'), ("b", "m", "n", "1")], key=str)


def test_null_keys_are_keys(spark):
    """Equal states give no ops and no differences; a provider's fact is set once and removed once."""
    a = spark.createDataFrame([("p", None, "provider.name", "1"), ("p", "m", "f", "1"), ("q", None, "x", "1"), ("q", "m", "f", "1")], S)
    assert diff.publish_delta(a, a, KEYS).count() == 0 and diff.diff_keyed(a, a, KEYS, "value_json").count() == 0
    ops, conflicts, _ = diff.publish_step(a, a, ["provider", "model"])
    assert ops.count() == 0 and conflicts.count() == 0
    b = spark.createDataFrame([("p", None, "provider.name", "2"), ("p", "m", "f", "1"), ("q", "m", "f", "1"), (None, None, None, "9")], S)
    delta = diff.publish_delta(a, b, KEYS)
    assert sorted(map(tuple, delta.collect()), key=str) == sorted([("p", None, "provider.name", "set", "2"), ("q", None, "x", "remove", None), (None, None, None, "set", "9")], key=str)
    rows = lambda df: sorted(map(tuple, df.select(*S.replace(" string", "").split(", ")).collect()), key=str)
    after, bad = diff.replay_change(a, delta, KEYS)
    assert rows(after) == rows(b)
    assert {r["violation"] for r in bad.collect()} == {"orphan_provider_facts", "unknown_provider"}
    assert rows(diff.replay_chain(a, delta.withColumn("pos", F.lit(1)), KEYS, ["pos"])) == rows(b)


def test_ops_of_both_levels_and_unknown_ones(spark):
    s = "pos long, op string, provider string, model string, fact_key string, value string"
    a = spark.createDataFrame([("p", None, "provider.name", "1"), ("p", "m", "f", "1")], S)
    ops = spark.createDataFrame([(0, "set_provider", "p", None, "provider.name", "2"), (1, "remove", "p", "m", "f", None), (2, "set", "p", "n", "f", "3"), (3, "set_provider", "q", None, "provider.name", "4"), (4, "set", "q", "m", "f", "5")], s)
    after, bad = diff.replay_change(a, ops, KEYS, order=["pos"])
    assert bad.count() == 0
    want = [("p", None, "provider.name", "2"), ("p", "n", "f", "3"), ("q", None, "provider.name", "4"), ("q", "m", "f", "5")]
    assert sorted(map(tuple, after.collect()), key=str) == sorted(want, key=str) == sorted(map(tuple, diff.replay_chain(a, ops, KEYS, ["pos"]).collect()), key=str)
    odd = spark.createDataFrame([(0, "rename", "p", "m", "f", None)], s)
    assert [r["violation"] for r in diff.replay_change(a, odd, KEYS)[1].collect()] == ["unknown_op"]
    with pytest.raises(Exception, match="unknown op: rename"):
        diff.replay_chain(a, odd, KEYS, ["pos"]).collect()
    leave = spark.createDataFrame([(0, "remove", "p", "m", "f", None)], s)
    assert [(r["provider"], r["violation"]) for r in diff.replay_change(a, leave, KEYS)[1].collect()] == [("p", "orphan_provider_facts")]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_order_is_checked_across_slices(spark, width):
    keys = ["a", "b", "c", "c", "e", "d", "f", "f0", "g", "a"]
    ops = spark.createDataFrame([(r, p, "p", k if k != "a" else None, "f") for r in (1, 2) for p, k in enumerate(keys if r == 1 else sorted(set(keys)))], "release long, pos long, provider string, model string, fact_key string").repartition(5)
    got = diff.rising(ops, ["release"], "pos", KEYS, width)
    assert sorted((r["release"], r["model"] or "") for r in got.collect()) == [(1, ""), (1, "c"), (1, "d")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
