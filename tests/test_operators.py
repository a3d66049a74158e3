"""Semantics on tiny literal tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from factledger.functions import claims, keys, money, times
from factledger.functions.claims import same_claim
from factledger.operators import asof, corrections, diff, judged, layers, ledger, reports, rules
from factledger.sources import documents, tables
from factledger.streaming import capture

E = "id long, k string, fact_key string, value_json string, boundary long"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,exponent,units,error", [("2.5", 0, 2, None), ("3.5", 0, 4, None), ("1e-7", 9, 100, None), ("-1", 9, None, "negative"), ("1e-12", 9, None, "rounds_to_zero"), ("1e-30", 9, None, "rounds_to_zero"), ("0.0", 9, 0, None), ("x", 9, None, "not_a_number"), (None, 9, None, "not_a_number")])
def test_minor_units(spark, text, exponent, units, error):
    df = spark.createDataFrame([(text,)], "t string").select(money.to_minor_units(F.col("t"), exponent).alias("m")).first()["m"]
    assert (df["units"], df["error"]) == (units, error)


def test_scalar_functions(spark):
    assert one(spark, money.exact_ratio(F.lit(6), F.lit(5), F.lit(4))) is None
    assert one(spark, money.exact_ratio(F.lit(8), F.lit(5), F.lit(4))) == 10
    assert one(spark, money.currency_code(F.lit(" usd "))) == "USD"
    k = one(spark, keys.parse_rate_key(F.lit("rate.input.above_context.200000.mode.fast")))
    assert (k["base"], k["above_context"], k["mode"], k["ttl"]) == ("input", 200000, "fast", None)
    assert one(spark, keys.parse_rate_key(F.lit("family"))) is None
    s = one(spark, keys.split_id(F.lit("lab/a/b")))
    assert (s["lab"], s["model"]) == ("lab", "a/b")
    assert [one(spark, keys.is_model_key(F.lit(x))) for x in ("a", "a b", "local:", "")] == [True, False, False, False]
    assert one(spark, claims.same_claim(F.lit('{"a":1, "b":[2,1]}'), F.lit('{"b":[2,1],"a":1}')))
    assert not one(spark, claims.same_claim(F.lit("[1,2]"), F.lit("[2,1]")))
    assert one(spark, times.days_overdue(F.lit(0), F.lit(times.DAY * 3 - 1))) == 2
    assert one(spark, times.utc_text(F.lit(times.DAY))) == "1970-01-02"


def test_closed_windows_and_open_uncertainty(spark):
    c = spark.createDataFrame([("a", 10, 20)], "k string, from_ms long, until_ms long")
    assert [corrections.corrections_at(c, t).count() for t in (9, 10, 20, 21)] == [0, 1, 1, 0]
    e = spark.createDataFrame([(1, "a", "f", "1", 5, None), (2, "a", "f", "2", 20, 10)], E + ", prior_ms long")
    facts = e.where("id = 1")
    assert [corrections.uncertain(facts, e, t, ["k", "fact_key"]).count() for t in (10, 11, 19, 20)] == [0, 1, 1, 0]


def test_apply_corrections_refuses_moved_facts(spark):
    e = spark.createDataFrame([(1, "a", "f", "1", 5), (2, "b", "f", "1", 5), (3, "a", "f", "2", 20), (4, "b", "f", "2", 50)], E)
    req = spark.createDataFrame([("a", "f", 10, 20, "x"), ("b", "f", 10, 20, "x")], "k string, fact_key string, from_ms long, until_ms long, reason string")
    plan = corrections.plan_corrections(req, e, req.limit(0), ["k", "fact_key"])
    out = corrections.apply_corrections(plan, e, 100, ["k", "fact_key"]).collect()
    assert sorted((r["k"], r["value_json"], r["kind"]) for r in out) == [("a", "2", "corrected"), ("b", "2", "corrected")]
    moved = e.unionByName(spark.createDataFrame([(5, "b", "f", "3", 60)], E))
    with pytest.raises(Exception, match="has changed since the plan"):
        corrections.apply_corrections(plan, moved, 100, ["k", "fact_key"]).collect()


@pytest.mark.parametrize(
    "eras,window,known,want",
    [
        ([(5, "1"), (20, "2")], (10, 20), [], []),  # the good value begins just where the window ends
        ([(5, "1"), (19, "2")], (10, 20), [], ["present_still_affected"]),  # began inside the window
        ([(5, "1")], (10, 20), [], ["present_still_affected"]),  # spans it
        ([(5, "1"), (25, "1")], (10, 20), [], ["unchanged"]),
        ([(5, "1"), (15, "9"), (25, "1")], (10, 20), [], []),  # a bad value came and went
        ([(5, "1"), (15, " 1 "), (25, "1")], (10, 20), [], ["unchanged"]),  # the same claim in other words
        ([(5, "2"), (10, "1"), (25, "1")], (10, 20), [], ["unchanged"]),  # in force when the window begins
        ([(12, "1"), (25, "2")], (10, 20), [], []),  # nothing was held when the window began
        ([(5, "1"), (25, "2")], (10, 20), ["x"], ["already_recorded"]),
        ([(5, "1"), (25, "2")], (10, 20), ["another reason"], []),
        ([], (10, 20), [], ["no_such_fact"]),
        ([(5, "1")], (20, 10), [], ["bad_window"]),
    ],
)
def test_when_a_correction_is_refused(spark, eras, window, known, want):
    s = "k string, fact_key string, from_ms long, until_ms long, reason string"
    e = spark.createDataFrame([(i, "a", "f", v, at) for i, (at, v) in enumerate(eras)], E)
    told = spark.createDataFrame([("a", "f", *window, r) for r in known], s)
    plan = corrections.plan_corrections(spark.createDataFrame([("a", "f", *window, "x"), ("z", "f", 1, 2, "x")], s), e, told, ["k", "fact_key"], together=["reason"])
    got = {r["k"]: r["refusals"] for r in plan.collect()}
    assert got == {"a": want or ["plan_refused"], "z": ["no_such_fact"]}


def test_diff_then_replay_restores_the_state(spark):
    a = spark.createDataFrame([("x", "f", "1"), ("x", "g", "2"), ("y", "f", "3")], "k string, fact_key string, value_json string")
    b = spark.createDataFrame([("x", "f", "1"), ("x", "g", "9"), ("z", "f", "4")], a.schema)
    key = ["k", "fact_key"]
    after, bad = diff.replay_change(a, diff.publish_delta(a, b, key), key)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, b.collect())) and bad.count() == 0
    digest = lambda d: diff.state_digest(diff.facts_digest(d, ["k"]), ["k"]).first()["digest"]
    assert digest(after) == digest(b) != digest(a)


def test_plan_ingest_withdraws_once(spark):
    s = "k string, fact_key string, value_json string"
    held = spark.createDataFrame([("x", "existence", '"present"'), ("x", "f", "1"), ("x", "g", "null")], s)
    new = spark.createDataFrame([("x", "existence", '"present"')], s)
    got = diff.plan_ingest(held, new, ["k"]).collect()
    assert [(r["fact_key"], r["value_json"], r["change"]) for r in got] == [("f", "null", "withdrawn")]


def _entity(spark, rows):
    """rows: {(provider, model): facts}."""
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "provider string, model string, facts map<string,string>")


def _of(entities):
    return {(r["provider"], r["model"]): dict(r["facts"]) for r in entities.collect()}


RULES = "provider string, class string, action string, target string, model_ids array<string>"


def test_plane_rules_read_the_facts_before_any_rule(spark):
    e = _entity(spark, {("p", "m"): {"rate.a": "1", "rate.b.above_context.9": "2"}, ("p", "n"): {"x": "1"}})
    rule = spark.createDataFrame([("p", "a", "billed_as", "b", None), ("p", "b", "stated_zero", None, ["m"])], RULES)
    nothing = '{"reason":"not_established","state":"unpriced"}'
    got = _of(layers.apply_plane(e, rule, keep_published=False))
    assert got["p", "m"] == {"rate.a": nothing, "rate.a.above_context.9": '{"key":"rate.b.above_context.9","state":"billed_as"}', "rate.b": '{"state":"stated_zero"}', "rate.b.above_context.9": '{"state":"stated_zero"}'}
    assert got["p", "n"] == {"x": "1", "rate.a": nothing}
    kept = _of(layers.apply_plane(e, rule, keep_published=True))
    assert kept["p", "m"]["rate.a"] == "1" and kept["p", "m"]["rate.b.above_context.9"] == "2" and kept["p", "m"]["rate.b"] == '{"state":"stated_zero"}'


def test_a_twin_prices_the_mode_of_its_base(spark):
    e = _entity(spark, {("p", "m"): {"rate.input": "1", "rate.input.mode.fast": "7"}, ("p", "m-fast"): {"rate.input": "2", "rate.input.above_context.5": "3", "rate.input.mode.x": "4"}, ("p", "b-fast"): {"rate.input": "5"}})
    t = spark.createDataFrame([("p", "m", "fast", "m-fast", "Fast"), ("p", "b", "fast", "b-fast", "Fast")], "provider string, base string, mode string, twin string, label string")
    got = _of(layers.apply_twins(e, t))
    assert got["p", "m"] == {"rate.input": "1", "rate.input.mode.fast": "2", "rate.input.mode.fast.above_context.5": "3", "route.mode_wire_ids": '{"fast":"m-fast"}', "route.mode_labels": '{"fast":"Fast"}'}
    assert got["p", "m-fast"]["model.mode_of"] == '{"mode":"fast","model_id":"m"}' and got["p", "m-fast"]["rate.input.mode.x"] == "4"
    assert ("p", "b") not in got  # a base that isn't served gets no row


def test_ranges_skip_aliases_and_those_without_temperature(spark):
    e = _entity(spark, {("p", "m"): {"capability.temperature": "false"}, ("p", "n"): {"x": "1"}, ("p", "a"): {"x": "1"}})
    e = e.withColumn("alias_of", F.when(F.col("model") == "a", F.struct(F.lit("p").alias("provider"), F.lit("n").alias("model"))))
    got = _of(layers.apply_ranges(e, spark.createDataFrame([("p", 0, 2)], "provider string, low int, high int")))
    assert [k for k, v in got.items() if "limit.temperature_max" in v] == [("p", "n")]


def _rate(n, more=""):
    return '{"state":"priced","units":%d,"exponent":9%s}' % (n, more)


def test_lifetimes_withhold_the_whole_card(spark):
    card = lambda i, w: {"rate.input": _rate(i), "rate.cache_write": _rate(w)}
    rows = {
        ("p", "good"): card(100, 125), ("p", "odd"): card(100, 125), ("p", "other"): card(100, 126), ("p", "free"): card(100, 125) | {"rate.input.above_context.9": "null", "rate.cache_write.above_context.9": "null"},
        ("p", "borrowed"): {"rate.input": _rate(100, ',"inherited_from":{}'), "rate.cache_write": _rate(125)}, ("p", "unruled"): card(100, 125),
    }
    two = lambda n, d: [("5m", 5, 4), ("1h", n, d)]
    rules_ = spark.createDataFrame([("p", m, ["5m", "1h"], two(7, 3) if m == "odd" else two(2, 1)) for m in ("good", "odd", "other", "free", "borrowed")], "provider string, model string, lifetimes array<string>, ratios array<struct<ttl string, num int, den int>>")
    got = _of(layers.apply_lifetimes(_entity(spark, rows), rules_))
    assert {m: sum(".ttl." in k for k in v) for (_, m), v in got.items()} == {"good": 2, "odd": 0, "other": 0, "free": 0, "borrowed": 0, "unruled": 0}
    assert got["p", "good"]["rate.cache_write.ttl.1h"] == _rate(200) and got["p", "odd"]["capability.cache_lifetimes"] == '["5m","1h"]' and "capability.cache_lifetimes" not in got["p", "unruled"]


def test_lineage_ends_at_the_first_kind_of_evidence(spark):
    e = _entity(spark, {("p", "m"): {"model.family": '"f"'}, ("p", "n"): {"model.family": '"unruled"', "model.canonical_id": '"lab/x"'}, ("p", "o"): {"model.canonical_id": '"lab/x"'}, ("p", "q"): {"model.canonical_id": '"nobody/x"'}, ("p", "r"): {"x": "1"}, ("p", "a"): {"model.family": '"f"'}, ("p", "b"): {"x": "1"}})
    e = e.withColumn("alias_of", F.when(F.col("model").isin("a", "b"), F.struct(F.lit("p").alias("provider"))))
    t = lambda *rows: spark.createDataFrame(list(rows), "key string, class string")
    got = _of(layers.lineage(e, t(("p/b", "1")), t(("f", "2")), t(("lab", "3")), t(("p", "4"))))
    assert {m: v.get("model.lineage") for (_, m), v in got.items()} == {"m": '"2"', "n": None, "o": '"3"', "q": None, "r": '"4"', "a": None, "b": '"1"'}


def test_grades_by_kind(spark):
    e = _entity(spark, {("p", "m"): {"x": "1"}, ("p", "i"): {"model.type": '"image"'}, ("p", "a"): {"x": "1"}, ("p", "c"): {"model.canonical_id": '"p/m"'}})
    e = e.withColumn("alias_of", F.when(F.col("model") == "a", F.struct(F.lit("p").alias("provider"))))
    g = spark.createDataFrame([("p/m", None, "10", "9", None, 5), ("p/m", "coding", None, None, "8", 6), ("p/i", None, "10", "9", None, 7), ("p/i", "image", None, None, "3", 4), ("p/a", None, "1", "1", None, 1), ("local:p/m", None, "0", "0", None, 99)], "key string, kind string, elo string, eq string, grade string, recorded_at_ms long")
    marks = spark.createDataFrame([("p/i", 8)], "key string, recorded_at_ms long")
    out = judged.apply_judgments(e, judged.judgments(g, marks))
    got = _of(out)
    full = {"quality.elo": "10", "quality.eq": "9", "quality.grade.coding": "8"}
    assert got["p", "m"] == {"x": "1", **full} and got["p", "c"] == {"model.canonical_id": '"p/m"', **full} and got["p", "a"] == {"x": "1"}
    assert got["p", "i"] == {"model.type": '"image"', "quality.grade.image": "3", "quality.decommissioned": "true"}
    assert {r["model"]: r["judged_at_ms"] for r in out.collect()} == {"m": 6, "i": 8, "a": None, "c": 6}


def test_requests_for_judgments(spark):
    e = _entity(spark, {("p", "m"): {"capability.reasoning_options": '[{"type":"effort","values":["low"]}]'}, ("p", "i"): {"model.type": '"image"', "capability.output_modalities": '["image"]', "model.canonical_id": '"lab/i"'}, ("p", "a"): {"x": "1"}})
    e = e.withColumn("alias_of", F.when(F.col("model") == "a", F.struct(F.lit("p").alias("provider"))))
    req = [
        ("p/m", None, "10", "9", None, "low", 0, "r", []), ("p/m", None, "10", None, None, None, 0, "r", ["dimensions"]), ("p/m", None, "-1", "9", None, "max", 0, " ", ["empty_reason", "not_positive", "effort_not_listed"]),
        ("lab/i", "image", None, None, "3", None, 0, "r", []), ("lab/i", "video", None, None, "3", "low", 0, "r", ["effort_without_chat", "no_evidence", "effort_not_listed"]), ("lab/i", None, "1", "1", None, None, 0, "r", ["not_chat"]), ("lab/i", "music", None, None, "3", None, 0, "r", ["unknown_kind"]),
        ("p/i", "image", None, None, "3", None, 0, "r", ["unknown_key"]), ("p/a", None, "1", "1", None, None, 0, "r", ["unknown_key"]), ("local:x", None, "1", "1", None, None, 0, "r", ["local_chat"]), ("local:x", "image", None, None, "x", None, 0, "r", ["not_positive"]), ("p/m", None, None, None, None, None, 1, "r", []),
    ]
    df = spark.createDataFrame([(n, *r[:-1]) for n, r in enumerate(req)], "n int, key string, kind string, elo string, eq string, grade string, graded_effort string, withdrawn int, reason string")
    got = {r["n"]: r["refusals"] for r in judged.check_grades(df, e).collect()}
    assert [got[n] for n in range(len(req))] == [r[-1] for r in req]
    work = [("p/m", "code", "low", None, False, 0, "r", []), ("p/m", "code", "max", "max", False, 0, "r", ["default_not_listed", "minimum_not_listed"]), ("p/m", "chat", None, None, True, 0, "r", ["unknown_workload"]), ("p/m", "code", None, "low", False, 0, "r", ["one_of"]), ("p/x", "code", None, None, True, 1, "", ["empty_reason", "one_of", "unknown_key"])]
    df = spark.createDataFrame([(n, *r[:-1]) for n, r in enumerate(work)], "n int, key string, workload string, effort_default string, effort_minimum string, excluded boolean, withdrawn int, reason string")
    got = {r["n"]: r["refusals"] for r in judged.check_workloads(df, e).collect()}
    assert [got[n] for n in range(len(work))] == [r[-1] for r in work]


def test_overrides_hold_while_upstream_says_the_same(spark):
    e = _entity(spark, {("p", "m"): {"limit.context": "10", "model.status": "null", "capability.reasoning_options": '[{"type":"effort","values":["low"]}]'}}).withColumn("withheld", F.array(F.lit("limit.output")))
    o = spark.createDataFrame([("p", "m", "limit.context", "20", " 10"), ("p", "m", "limit.output", "5", None), ("p", "m", "model.status", '"deprecated"', None), ("p", "m", "capability.reasoning_default", '{"type":"effort","value":"high"}', None), ("q", "z", "x", "1", None)], "provider string, model string, fact_key string, value string, replaces string")
    r = layers.apply_overrides(e, o).collect()
    assert [dict(x["overridden"]) for x in r] == [{"limit.context": "20", "model.status": '"deprecated"'}] and r[0]["facts"]["limit.context"] == "20"


def test_a_returning_entity_is_new(spark):
    s = "k string, fact_key string, value_json string"
    held = spark.createDataFrame([("x", "existence", '"absent"'), ("x", "f", "1"), ("x", "g", "2"), ("y", "existence", '"absent"'), ("z", "existence", '"present"')], s)
    new = spark.createDataFrame([("x", "existence", '"present"'), ("x", "f", "1"), ("x", "h", "3")], s)
    got = {(r["k"], r["fact_key"]): (r["value_json"], r["change"]) for r in diff.plan_ingest(held, new, ["k"]).collect()}
    assert got == {("x", "existence"): ('"present"', "new"), ("x", "h"): ("3", "new"), ("x", "g"): ("null", "withdrawn"), ("z", "existence"): ('"absent"', "disappeared")}


def test_origin_is_the_boundary_of_the_least_id(spark):
    e = spark.createDataFrame([("k", 1, 50, "b"), ("k", 2, 40, "a"), ("k", 3, 10, "a"), ("k", 4, 30, "a")], "k string, id long, boundary long, claim string")
    assert ledger.run_origin(e, 100, ["k"], "claim").first()["origin"] == 40


def test_annotations_are_no_part_of_a_claim(spark):
    a, b = '{"units":1,"state":"priced","unit_provenance":{"kind":"assumed_by_policy","policy":"x"}}', '{"state": "priced", "units": 1}'
    d = spark.createDataFrame([(a, b), (b.replace("1", "2"), b), ('{"unit_provenance":{"kind":"stated"}}', "{}")], "a string, b string")
    assert [r[0] for r in d.select(same_claim(F.col("a"), F.col("b"))).collect()] == [True, False, True]


REVIEWED = {"source_ref": "https://x", "quote": "q", "established_at_ms": 0, "review_by_ms": 60 * 86_400_000}


@pytest.mark.parametrize(
    "kind,schema,rows_,want",
    [
        ("speed_twins", "provider string, base string, mode string, twin string, label string, api_card string", [("p", "a", "fast", "b", "l", "p/b"), ("p", "b", "fast", "c", "l", "p/c"), ("p", "d", "fast", "e", "l", "p/e"), ("p", "f", "fast", "e", "l", "p"), ("p", "g", "slow", "h", "l", "p/h")], [["twin_is_base"], [], ["duplicate_twin"], ["api_card", "duplicate_twin"], ["unknown_mode"]]),
        ("login_methods", "provider string, model string, methods array<string>", [("p", "up", ["apikey"]), ("p", "cur", ["oauth"]), ("p", "none", ["apikey", "apikey"]), ("p", "up2", ["sms"])], [[], ["curated"], ["repeated_method", "missing_upstream"], ["unknown_method"]]),
        ("attachment_limits", "provider string, fact_key string, modality string, kind string, value long, at long, other long, conditions array<struct<above long, value long>>, notes string", [("p", "limit.image_long_edge_px", "image", "image_count", 8, None, None, [(20, 5)], "n"), ("q", "limit.image_long_edge_px", "image", "image_count", 8, None, None, [(20, 9)], "n"), ("r", "limit.image_long_edge_px", "image", "image_count", 8, None, None, [(20, 5), (20, 4)], "n"), ("s", "limit.document_pages", "image", "fixed", 1, None, None, None, "n"), ("t", "limit.image_bytes", "image", "context_at_least", 1, 0, 1, None, "n")], [[], ["not_stricter"], ["duplicate_threshold"], ["modality"], ["threshold"]]),
        ("cache_lifetimes", "provider string, model string, lifetimes array<string>, ratios array<struct<ttl string, num int, den int>>", [("p", "a", ["5m", "1h"], [("5m", 5, 4), ("1h", 2, 1)]), ("p", "b", ["5m", "1h"], [("5m", 5, 4)]), ("p", "c", ["24h"], []), ("p", "d", ["2h"], []), ("p", "e", ["24h"], [("24h", 0, 1)])], [[], ["missing_multiplier"], [], ["unknown_lifetimes"], ["zero_ratio", "missing_multiplier"]]),
        ("fact_overrides", "provider string, model string, fact_key string, value string, replaces string, reason string", [("p", "a", "limit.context", "2", "1", "r"), ("p", "a", "limit.input", "2", "1", "r"), ("p", "a", "model.status", '"deprecated"', '"x"', "r"), ("p", "b", "capability.reasoning_default", '{"type":"effort","value":""}', None, "r"), ("p", "b", "capability.temperature", "1", "true", "r")], [[], ["not_overridable"], ["addition"], ["default_effort"], ["not_boolean"]]),
    ],
)
def test_rule_tables_reject_what_they_must(spark, kind, schema, rows_, want):
    more = REVIEWED
    df = spark.createDataFrame([(*r, *more.values()) for r in rows_], schema + ", source_ref string, quote string, established_at_ms long, review_by_ms long")
    ids = lambda *m: spark.createDataFrame([("p", x) for x in m], "provider string, model string")
    _, bad = rules.load_rules(df, rules.specs()[kind], {"upstream": ids("up", "cur", "up2"), "curated": ids("cur")})
    names = df.columns[: len(rows_[0])]
    got = {tuple(map(str, (r[n] for n in names))): r["reasons"] for r in bad.collect()}
    plain = lambda r: tuple(map(str, df.where(F.lit(True)).sparkSession.createDataFrame([r], schema).first()))
    assert got == {plain(r): w for r, w in zip(rows_, want) if w}


def test_a_plane_rule_may_not_bill_as_a_ruled_class(spark):
    df = spark.createDataFrame([("p", "oauth", "input", "billed_as", "output", None), ("p", "oauth", "output", "stated_zero", None, None), ("q", "oauth", "input", "billed_as", "output", [" "])], "provider string, auth_method string, class string, action string, target string, model_ids array<string>").withColumn("source_ref", F.lit("s")).withColumn("established_by", F.lit("e"))
    assert {(r["provider"], r["class"]): r["reasons"] for r in rules.load_rules(df, rules.specs()["billing_rules"])[1].collect()} == {("p", "input"): ["billed_as_ruled"], ("q", "input"): ["empty_model"]}


def test_audits_of_aliases_twins_and_successors(spark):
    f = spark.createDataFrame([("p", "m", "capability.reasoning_options", '[{"type":"effort","values":["low"]}]'), ("p", "m", "rate.input.mode.fast", "1"), ("p", "known", "existence", '"present"')], "provider string, model string, fact_key string, value_json string")
    al = spark.createDataFrame([("p", "a", "p", "m", {"low": "L", "max": "M"}), ("p", "b", "p", "no", None), ("p", "known", "p", "m", None)], "provider string, model string, target_provider string, target string, wire_ids map<string,string>")
    assert sorted((r["model"], r["finding"], r["detail"]) for r in rules.audit_aliases(al, f).collect()) == [("a", "effort_drift", "max"), ("b", "missing_target", None), ("known", "recorded", None)]
    tw = spark.createDataFrame([("p", "m", "fast", "gone")], "provider string, base string, mode string, twin string")
    assert sorted(r["finding"] for r in rules.audit_twins(tw, f).collect()) == ["colliding", "missing"]
    ret = spark.createDataFrame([("p", "old", "m"), ("p", "older", "nobody"), ("p", "known", None)], "provider string, model string, successor string")
    assert sorted((r["model"], r["finding"]) for r in rules.audit_successors(ret, f, f).collect()) == [("known", "present"), ("older", "invalid_successor")]


def test_replay_and_chain_checks(spark):
    s = "provider string, model string, fact_key string, value_json string"
    held = spark.createDataFrame([("p", None, "provider.name", "1"), ("p", "m", "f", "1")], s)
    ops = spark.createDataFrame([(1, "q", None, "provider.name", "set", "2"), (2, "p", "m", "f", "remove", None), (3, "p", "m", "x", "remove", None)], "pos int, provider string, model string, fact_key string, op string, value string")
    _, bad = diff.replay_change(held, ops, ["provider", "model", "fact_key"], order=["pos"])
    assert sorted((r["provider"], r["violation"]) for r in bad.collect()) == [("p", "not_sorted"), ("p", "orphan_provider_facts"), ("p", "removes_nothing"), ("q", "orphan_provider_facts"), ("q", "unknown_provider")]
    chain = spark.createDataFrame([(i, p, "m", f"k{p}", "set", str(p)) for i in (1, 2) for p in (1, 2)], "release long, pos int, provider string, fact_key string, op string, value string").withColumn("model", F.lit("m"))
    chain = chain.withColumn("provider", F.when((F.col("release") == 2) & (F.col("pos") == 2), "a").otherwise("b"))
    d = diff.change_digests(chain)
    digest = {r["release"]: r["digest"] for r in d.collect()}
    rel = spark.createDataFrame([(1, None, 10, 2, digest[1], 1, False, "c", "u"), (2, 1, 20, 2, "other", 1, True, "c", "u"), (3, 2, 30, 0, None, 2, True, "c", "u")], "release long, parent long, published_at_ms long, n_ops int, change_hash string, curation_version int, curation_changed boolean, curation_hash string, upstream_hash string")
    rel = rel.withColumn("state_hash", F.when(F.col("release") == 3, F.lit("x")).otherwise(diff.state_hash(F.col("curation_hash"), F.col("upstream_hash"))))
    assert sorted((r["release"], r["violation"]) for r in diff.verify_chain(rel, d).collect()) == [(2, "change_hash"), (2, "curation_version"), (2, "not_sorted"), (3, "state_hash")]


def test_served_timeline(spark):
    e = spark.createDataFrame([(1, "a", "f", "1", 10), (2, "a", "f", " 1", 20), (3, "a", "f", "2", 30), (4, "a", "f", "null", 60)], E)
    c = spark.createDataFrame([("a", "f", 35, 39), ("a", "f", 5, 8)], "k string, fact_key string, from_ms long, until_ms long")
    o = spark.createDataFrame([("a", "f", "9", "2", 45, 1), ("a", "f", None, None, 50, 2)], "k string, fact_key string, value string, replaces string, boundary long, id long")
    got = sorted(tuple(r[x] for x in ("from_ms", "until_ms", "state", "value", "source")) for r in corrections.served_timeline(e, c, ["k", "fact_key"], o).collect())
    assert got == [(10, 20, "value", "1", "upstream"), (20, 30, "value", " 1", "upstream"), (30, 35, "value", "2", "upstream"), (35, 40, "refused", None, None), (40, 45, "value", "2", "upstream"), (45, 50, "value", "9", "override"), (50, 60, "value", "2", "upstream"), (60, None, "absent", None, None)]


def test_as_of_join_in_stretches_is_the_same_join(spark):
    import random

    rng = random.Random(2)
    e = spark.createDataFrame([(i, rng.choice("ab"), "f", str(i), rng.randrange(1000)) for i in range(60)], E)
    left = spark.createDataFrame([(i, rng.choice("abc"), rng.choice([None, *range(0, 1200, 7)])) for i in range(200)], "n int, k string, at long")
    rows_ = lambda **o: sorted(map(str, asof.as_of_join(left, e, ["k"], "at", ["value_json"], **o).collect()))
    assert rows_() == rows_(bucket_ms=100) == rows_(bucket_ms=7) and rows_(how="inner") == rows_(how="inner", bucket_ms=50)


def test_fact_keys_of_fields(spark):
    d = spark.createDataFrame([("rate", "input", None), ("rate", "input", "fast"), ("rate", "input", "Fast!"), ("limit", "context", None), ("tier_rate", "input", None), ("existence", None, None), ("provider_name", None, None)], "kind string, name string, mode string")
    assert [r[0] for r in d.select(keys.fact_key_for(F.col("kind"), F.col("name"), F.col("mode"))).collect()] == ["rate.input", "rate.input.mode.fast", None, "limit.context", None, "existence", "provider.name"]


def test_the_poll_stream_classifies_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    doc = lambda price, models=("m",): json.dumps({"p": {"name": "P", "models": {m: {"family": "f", "cost": {"input": price}} for m in models}}})
    many = tuple(f"m{i}" for i in range(120))
    for n, text in enumerate([doc(1, many), doc(1, many), " " + doc(1, many), doc(2, many), "no document", doc(2, many[:20]), doc(2, many)]):
        (tmp_path / "in" / f"{n}.json").write_text(text)
        os.utime(tmp_path / "in" / f"{n}.json", (n, n))  # the order in which they landed
    clock = iter(range(100, 1000, 100))
    parse = lambda raw: documents.to_facts(documents.normalise_models(documents.parse_documents(raw)))
    q = capture.poll_stream(spark, str(tmp_path / "in"), str(tmp_path / "eras"), "src", str(tmp_path / "obs"), str(tmp_path / "cp"), lambda: next(clock), parse)
    q.awaitTermination(300)
    assert q.exception() is None
    obs = tables.read_table(spark, str(tmp_path / "obs")).orderBy("id").collect()
    assert [(o["outcome"], o["failure_class"]) for o in obs] == ([("changed", None), ("not_modified", None), ("unchanged", None), ("changed", None), ("failed", "parse"), ("failed", "implausible"), ("unchanged", None)])


def test_seed_confirms_for_the_first_observed_era(spark, tmp_path):
    f = spark.createDataFrame([("p", "m", "f", "1")], "provider string, model string, fact_key string, value_json string")
    e, o = str(tmp_path / "e"), str(tmp_path / "o")
    assert tables.seed_if_empty(spark, f, e, "src", 5, o) and not tables.seed_if_empty(spark, f, e, "src", 6, o)
    seen = tables.read_table(spark, o)
    assert [(r["outcome"], r["observed_at_ms"]) for r in seen.collect()] == [("seeded", 5)]
    new = tables.read_table(spark, e).withColumn("boundary", F.lit(9).cast("long")).withColumn("kind", F.lit("observed"))
    tables.append_eras(new, seen, e, 9, 100)
    got = tables.read_eras(spark, e, "src", "p", "p").orderBy("boundary")
    assert [(r["kind"], r["prior_ms"], r["observation_id"]) for r in got.collect()] == [("seed", None, None), ("observed", 5, None)]
    assert "batch" in got._jdf.queryExecution().toString() and tables.read_eras(spark, e, "src", "q").count() == 0


def test_the_first_row_of_a_key_may_stay(spark):
    r = spark.createDataFrame([("p", "f", "z", 2), ("p", "f", "y", 1)], "provider string, model string, target string, pos int")
    ok, bad = rules.load_rules(r, rules.RuleSpec(("provider", "model"), ("target",), first_by="pos"))
    assert [x["target"] for x in ok.collect()] == ["y"] and [(x["target"], x["reasons"]) for x in bad.collect()] == [("z", ["duplicate_key"])]


def test_rules_report_every_reason(spark):
    r = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "d", "d"), ("p", "e", ""), ("p", "f", "z"), ("p", "f", "z")], "provider string, model string, target string")
    ok, bad = rules.load_rules(r, rules.RuleSpec(("provider", "model"), ("target",), target=("provider", "target")))
    assert [x["model"] for x in ok.collect()] == ["b"]
    assert {x["model"]: x["reasons"] for x in bad.collect()} == {"a": ["chained_target"], "d": ["self_target"], "e": ["empty_target"], "f": ["duplicate_key"]}
    assert {"aliases", "billing_rules", "wire_families", "judgments"} <= set(rules.specs()) and len(rules.specs()) == 21


def test_judgments(spark):
    log = spark.createDataFrame([(1, "m", "5", 0, 1)], "id long, model string, grade string, withdrawn int, recorded_at_ms long")
    req = spark.createDataFrame([("m", "5", 0), ("n", "-1", 0), ("o", None, 1), ("p", "7", 0)], "model string, grade string, withdrawn int")
    ok, no = ledger.append_judgments(req, log, ["model"])
    assert [r["model"] for r in ok.collect()] == ["p"]
    assert {r["model"]: r["reasons"][0] for r in no.collect()} == {"m": "no_change", "n": "not_a_positive_number", "o": "nothing_to_withdraw"}


TIERS = [{"tier": {"type": "context", "size": 1000}, "input": 3}, {"tier": {"type": "context"}, "input": 7}]
MODEL = {"name": "", "family": "f", "open_weights": True, "temperature": False, "limit": {"context": 0, "output": 5}, "modalities": {"input": ["text", "image"], "output": ["text"]}, "reasoning_options": [{"type": "effort", "values": ["low"]}], "provider": {"api": "https://own", "shape": "s"}}
COSTS = {
    "good": {"input": 1.5, "output": 0, "image": 4, "tiers": TIERS, "context_over_200k": {"input": 3}},
    "negative": {"input": 1, "reasoning": -1},
    "tier": {"input": 1, "tiers": [{"tier": {"type": "odd", "size": 1}, "input": 9}]},
    "untyped": {"input": 1, "tiers": [{"tier": {"size": 1}, "input": 9}]},
    "orphan": {"input": 1, "tiers": TIERS, "context_over_200k": {"input": 4}},
    "audio": {"input": 1, "input_audio": 2, "output_audio": 3},
    "audio_tier": {"input": 1, "input_audio": 2, "tiers": [{"tier": {"type": "context", "size": 9}, "input": 1, "input_audio": 3}]},
    "text": {"input": "cheap"},
}
MODES = {"fast": {"cost": {"input": 2}}, "pro": {}, "Bad": {"cost": {"input": 1}}, "list": [1], "odd": {"cost": 5}, "unit": {"cost": {"input": 1, "image": 1}}, "minus": {"cost": {"input": -1}}}
DOC = {"p": {"name": "P", "npm": "n", "api": "https://given", "models": {k: MODEL | {"cost": c} for k, c in COSTS.items()} | {"modes": MODEL | {"cost": {"input": 1}, "experimental": {"modes": MODES}}}}}


def test_nested_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOC))
    m = documents.normalise_models(documents.read_documents(spark, str(tmp_path)))
    audio = spark.createDataFrame([("p", "input_audio")], "provider string, class string")
    facts: dict = {}
    for r in documents.to_facts(m, audio).collect():
        facts.setdefault(r["model"], {})[r["fact_key"]] = r["value_json"]
    good = facts["good"]
    assert good["limit.context"] == "null" and good["limit.output"] == "5" and good["model.family"] == '"f"' and good["capability.temperature"] == "false" and good["provider.name"] == '"P"' and good["existence"] == '"present"'
    assert good["capability.input_modalities"] == '["image","text"]' and "model.name" not in good and good["model.canonical_id"] == "null" and json.loads(good["capability.reasoning_options"]) == MODEL["reasoning_options"]
    assert json.loads(good["wire.npm"]) == {"value": "n", "from": "provider"} and json.loads(good["wire.api"]) == {"value": "https://own", "from": "model"} and json.loads(good["wire.shape"]) == {"value": "s", "from": "model"}
    rate = {k: {f: json.loads(v) for f, v in x.items() if f.startswith("rate.")} for k, x in facts.items()}
    assert {k: v.get("units", 0) for k, v in rate["good"].items()} == {"rate.input": 1_500_000_000, "rate.output": 0, "rate.input.above_context.1000": 3_000_000_000}
    assert {k: sorted(v) for k, v in rate.items() if k != "good"} == {"negative": [], "tier": [], "untyped": [], "orphan": [], "text": [], "audio": ["rate.input", "rate.input_audio"], "audio_tier": ["rate.input", "rate.input.above_context.9"], "modes": ["rate.input", "rate.input.mode.fast"]}
    found = sorted((r["model"], r["fact_key"], r["finding"]) for r in documents.rates(m, audio)[1].collect())
    assert found == sorted([
        ("good", "rate.image", "unknown_unit"), ("negative", "rate.reasoning", "negative"), ("tier", "rate.tiers", "unknown_tier_type"), ("untyped", "rate.tiers", "tier_without_type"), ("orphan", "rate.context_over_200k", "orphaned_older_tier"), ("text", "rate.input", "not_a_number"),
        ("audio", "rate.output_audio", "unknown_unit"), ("audio_tier", "rate.input_audio", "unknown_unit"), ("modes", "rate.mode", "bad_mode_name"), ("modes", "rate.mode", "not_an_object"), ("modes", "rate.mode", "cost_is_no_object"), ("modes", "rate.image.mode.unit", "unknown_unit"), ("modes", "rate.input.mode.minus", "negative"),
    ])
    (tmp_path / "d.json").write_text("[]")
    with pytest.raises(Exception, match="not a map"):
        documents.read_documents(spark, str(tmp_path)).count()


def test_batches_are_seen_only_when_committed(spark, tmp_path):
    f = spark.createDataFrame([("p", "m", "f", "1")], "provider string, model string, fact_key string, value_json string")
    path = str(tmp_path / "era")
    assert tables.seed_if_empty(spark, f, path, "s", 5) and not tables.seed_if_empty(spark, f, path, "s", 6)
    spark.read.parquet(f"{path}/data").withColumn("batch", F.lit("torn")).write.mode("append").partitionBy("batch").parquet(f"{path}/data")
    assert tables.read_table(spark, path).count() == 1
    obs = spark.createDataFrame([(1, "s", 3, "changed"), (2, "s", 8, "failed")], "id long, source string, observed_at_ms long, outcome string")
    e = f.select(F.lit("s").alias("source"), "*", F.lit(10).cast("long").alias("boundary"), F.lit("observed").alias("kind"), F.lit(2).cast("long").alias("observation_id"), *[F.lit(None).cast("long").alias(c) for c in ("from_ms", "until_ms")], F.lit(None).cast("string").alias("reason"))
    tables.append_eras(e, obs, path, 11, 100)
    assert tables.read_table(spark, path).where("kind = 'observed'").first()["prior_ms"] == 3
    with pytest.raises(Exception, match="no confirming poll"):
        tables.append_eras(e.withColumn("boundary", F.lit(2).cast("long")), obs, path, 12, 200)
    assert tables.read_table(spark, path).count() == 2


def test_poll_and_releases(spark):
    s = "provider string, model string, fact_key string, value_json string"
    cur = spark.createDataFrame([("p", str(i), "existence", '"present"') for i in range(120)], s)
    assert capture.poll_batch(cur, cur.limit(10), ["provider", "model"])[0] == "failed"
    outcome, plan = capture.poll_batch(cur, cur.where("model <> '3'"), ["provider", "model"])
    assert outcome == "changed" and plan.collect()[0]["change"] == "disappeared"
    ops = spark.createDataFrame([(1, 0, "set", "p", "1", "f", "7"), (3, 0, "set", "p", "1", "f", "8")], "release long, pos int, op string, provider string, model string, fact_key string, value string")
    with pytest.raises(ValueError, match="missing"):
        capture.apply_releases(cur, ops, 0)


def test_stream_capture_agrees_with_batch(spark, tmp_path):
    from factledger.operators.asof import changes

    rows = [(k, str(v), t, t) for k in "ab" for t, v in enumerate([1, 1, 2, 2, 1])]
    src = spark.createDataFrame(rows, "key string, value_json string, boundary long, id long")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    q = capture.start_capture(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = changes(src, ["key"]).select("key", "value_json", "boundary").collect()
    assert sorted((r["key"], r["value_json"], r["boundary"]) for r in got) == sorted(map(tuple, want))
    assert {r["prior_ms"] for r in got} == {None, 1, 3}


def test_limits_by_condition(spark):
    e = spark.createDataFrame([("p", "a", ["text", "image"], 10), ("p", "b", ["image"], None), ("p", "c", ["text"], 10)], "provider string, model string, modalities array<string>, context long")
    lim = spark.createDataFrame([("p", "l.eq", "image", "context_equals", 1, 10, 2, None), ("p", "l.at", "image", "context_at_least", 1, 11, 2, None), ("p", "l.n", "image", "image_count", 8, None, None, [(20, 5)])], "provider string, fact_key string, modality string, kind string, value long, at long, other long, conditions array<struct<above long, value long>>")
    got = {(r["model"], r["fact_key"]): r["value_json"] for r in judged.limit_facts(e, lim).collect()}
    assert got == {("a", "l.eq"): "1", ("a", "l.at"): "2", ("a", "l.n"): "8", ("a", "l.n.above_images.20"): "5", ("b", "l.n"): "8", ("b", "l.n.above_images.20"): "5"}


def test_efforts_are_gated_by_the_list(spark):
    e = spark.createDataFrame([("p", "m", None, False, ["low"]), ("p", "alias", None, True, ["low"]), ("p", "n", None, False, None)], "provider string, model string, canonical_id string, is_alias boolean, efforts array<string>")
    graded = spark.createDataFrame([("p/m", "low", 5), ("p/n", "low", 6)], "key string, effort string, recorded_at_ms long")
    derived = spark.createDataFrame([("p/m", "low", 1.0, 1.0, 5), ("p/m", "high", 1.0, None, 5)], "key string, effort string, elo double, eq double, recorded_at_ms long")
    work = spark.createDataFrame([("p/n", "chat", "low", "max", False, 9), ("p/m", "chat", "low", "max", True, 9)], "key string, workload string, effort_default string, effort_minimum string, excluded boolean, recorded_at_ms long")
    got = {(r["model"], r["fact_key"]): r["value_json"] for r in judged.effort_facts(e, graded, derived, work).collect()}
    assert got == {("m", "quality.graded_effort"): '"low"', ("m", "workload.chat.excluded"): "true", ("n", "workload.chat.effort_minimum"): '"max"'}


def test_scope_is_refused_not_empty(spark):
    e = spark.createDataFrame([("p", "m", 10)], "provider string, model string, boundary long")
    assert reports.select_scope(e, "p", "m", 10).count() == 1
    with pytest.raises(ValueError):
        reports.select_scope(e, model="m")
    assert reports.select_scope(e, low="o", high="q").count() == 1
    for scope in (dict(provider="q"), dict(provider="p", model="x"), dict(at=9), dict(low="q"), dict(high="o")):
        with pytest.raises(reports.NoCoverage):
            reports.select_scope(e, **scope)
    price = spark.createDataFrame([("p", 1, 10, "5")], "provider string, id long, boundary long, price string")
    sub = spark.createDataFrame([("p", "q", 1, 1)], "provider string, value string, boundary long, id long")
    assert reports.price_list(price, sub, sub.limit(0), sub.limit(0), 20, ["provider"], "price", "p").first()["quota_value"] == "q"
    with pytest.raises(reports.NoCoverage):
        reports.price_list(price, sub, sub, sub, 20, ["provider"], "price", "other")


VIEW = "id long, provider string, model string, fact_key string, value_json string, boundary long, prior_ms long"
EXISTS = {"existence": '"present"'}


def _eras(spark, rows, extra=()):
    flat = [(i, *e, k, v, 1, None) for i, (e, k, v) in enumerate((e, k, v) for e, facts in rows.items() for k, v in facts.items())]
    return spark.createDataFrame([*flat, *extra], VIEW)


def _view(spark, e, rules_, **options):
    from factledger.plans.view import served_view

    got: dict = {}
    for r in served_view(e, rules_, **options).facts.collect():
        got.setdefault((r["provider"], r["model"]), {})[r["fact_key"]] = r["value_json"]
    return got


def test_current_view_with_every_layer(spark):
    from factledger.plans.view import Plane, Rules

    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    e = _eras(spark, {
        ("p", "m"): EXISTS | {"provider.name": '"P"', "model.name": "null", "model.family": '"fam"', "model.open_weights": "true", "limit.context": "10", "capability.input_modalities": '["image","text"]', "rate.input": _rate(100), "rate.cache_write": _rate(125), "rate.input_audio": _rate(9), "capability.reasoning_options": '[{"type":"effort","values":["low","high"]}]', "wire.npm": '{"value":"kit","from":"model"}', "wire.api": '{"value":"u","from":"model"}'},
        ("q", "m"): EXISTS | {"model.family": '"fam"', "model.open_weights": "true"},  # inherits
        ("q", "m-fast"): EXISTS | {"rate.input": _rate(200)},
        ("q", "gone"): {"existence": '"absent"', "limit.context": "1"},
        ("q", "dead"): {"existence": '"absent"', "limit.context": "1"},  # an alias row names it, but it was recorded
    })
    r = Rules(
        overrides=t([("p", "m", "limit.context", "20", "10")], "provider string, model string, fact_key string, value string, replaces string"),
        endpoints=t([("q", "*", '{"value":"star"}')], "provider string, model string, value string"),
        families=t([("kit", None, "chatlike")], "npm string, shape string, family string"),
        links=t([("p", "m", '"lab/m"')], "provider string, model string, value string"),
        creators=t([("fam", "p")], "family string, creator string"),
        aliases=t([("q", "al", "p", "m", "Al", {"high": "H"}), ("q", "dead", "p", "m", None, None)], "provider string, model string, target_provider string, target string, name string, wire_ids map<string,string>"),
        curated=t([("q", "gone", {"limit.context": "7"}, ["key"]), ("q", "m", {"limit.context": "8"}, ["key"])], "provider string, model string, facts map<string,string>, auth_methods array<string>"),
        lifetimes=t([("p", "m", ["5m"], [("5m", 5, 4)])], "provider string, model string, lifetimes array<string>, ratios array<struct<ttl string, num int, den int>>"),
        limits=t([("p", "limit.image_bytes", "image", "context_at_least", 5, 15, 2, None), ("q", "limit.image_bytes", "image", "fixed", 3, None, None, None)], "provider string, fact_key string, modality string, kind string, value long, at long, other long, conditions array<struct<above long, value long>>"),
        ranges=t([("p", 0, 2), ("q", 0, 1)], "provider string, low int, high int"),
        audio=t([("p", 25)], "provider string, value long"),
        audio_overrides=t([("p", "m", 32)], "provider string, model string, value long"),
        lineage=(t([], "key string, class string"), t([], "key string, class string"), t([("lab", "L")], "key string, class string"), t([("q", "Q")], "key string, class string")),
        judgments=judged.judgments(t([("lab/m", None, "10", "9", None, 5)], "key string, kind string, elo string, eq string, grade string, recorded_at_ms long"), None, t([("lab/m", "low", 6)], "key string, effort string, recorded_at_ms long"), None, t([("lab/m", "chat", "high", "low", False, 9)], "key string, workload string, effort_default string, effort_minimum string, excluded boolean, recorded_at_ms long")),
        twins=t([("q", "m", "fast", "m-fast", "Fast")], "provider string, base string, mode string, twin string, label string"),
        retired=t([("q", "old", "m")], "provider string, model string, successor string"),
        policy="assumed",
    )
    got = _view(spark, e, r)
    m, heir, al = got["p", "m"], got["q", "m"], got["q", "al"]
    assert set(got) == {("p", "m"), ("q", "m"), ("q", "m-fast"), ("q", "al"), ("q", "gone")}
    assert "model.name" not in m and m["limit.context"] == "20" and m["wire.family"] == '"chatlike"' and m["model.canonical_id"] == '"lab/m"' and m["limit.image_bytes"] == "5" and m["limit.temperature_max"] == "2" and m["limit.audio_tokens_per_second"] == "32"
    assert '"unit_provenance":{"kind":"assumed_by_policy","policy":"assumed"}' in m["rate.input"] and m["rate.cache_write.ttl.5m"].startswith('{"state":"priced","units":125,')
    assert m["quality.elo"] == "10" and m["quality.graded_effort"] == '"low"' and m["workload.chat.effort_default"] == '"high"' and "model.lineage" not in m  # a family without a rule ends the search
    assert '"basis":"open_weights"' in heir["rate.input"] and heir["wire.api"] == '{"value":"star"}' and heir["limit.context" if "limit.context" in heir else "existence"] == '"present"'
    assert heir["rate.input.mode.fast"].startswith('{"state":"priced","units":200') and heir["route.mode_wire_ids"] == '{"fast":"m-fast"}' and got["q", "m-fast"]["model.mode_of"] == '{"mode":"fast","model_id":"m"}'
    assert al["model.name"] == '"Al"' and "wire.api" not in al and "limit.image_bytes" not in al and "limit.temperature_max" not in al and al["limit.audio_tokens_per_second"] == "32" and '"basis":"alias"' in al["rate.input"] and al["model.lineage"] == '"L"'
    assert al["capability.reasoning_options"] == '[{"type":"effort","values":["high"]}]' and al["workload.chat.effort_default"] == '"high"' and "quality.graded_effort" not in al
    assert got["q", "gone"]["limit.context"] == "7" and "existence" not in got["q", "gone"]
    retired = _view(spark, e, r, include_retired=True, prefixes=["existence", "successor", "limit.context"])
    assert retired["q", "old"] == {"existence": '"absent"', "successor": '"m"'} and retired["q", "dead"] == {"existence": '"absent"', "limit.context": "1"} and retired["q", "gone"]["limit.context"] == "7"
    r.plane_rules = t([("q", "cache_write", "billed_as", "input", None)], RULES)
    plane = _view(spark, e, r, plane=Plane("q", "key", "quota_proxy"))
    assert set(k for k, _ in plane) == {"q"} and '"basis":"open_weights"' in plane["q", "m"]["rate.input"] and '"basis":"quota_proxy"' in plane["q", "m-fast"]["rate.input"]
    assert plane["q", "m"]["rate.cache_write"] == '{"key":"rate.input","state":"billed_as"}'
    borrowed = _view(spark, e, r, plane=Plane("q", "sub", "quota_proxy", rates_from="p"), prefixes=["rate."])
    assert borrowed["q", "m"]["rate.output"] == '{"reason":"no_api_card","state":"unpriced"}'


def test_a_dated_view_has_no_current_layers(spark):
    from factledger.plans.view import Rules, served_view

    e = _eras(spark, {("p", "m"): EXISTS | {"model.family": '"fam"', "model.open_weights": "true", "rate.input": _rate(1)}, ("q", "m"): EXISTS | {"model.family": '"fam"', "model.open_weights": "true", "rate.input": _rate(2)}}, [(90, "q", "m", "rate.output", _rate(3), 50, 5)])
    r = Rules(creators=spark.createDataFrame([("fam", "p")], "family string, creator string"), ranges=spark.createDataFrame([("p", 0, 2)], "provider string, low int, high int"), overrides=spark.createDataFrame([("q", "m", "rate.input", _rate(9), None)], "provider string, model string, fact_key string, value string, replaces string"))
    c = spark.createDataFrame([("q", "m", "rate.input", 5, 20)], "provider string, model string, fact_key string, from_ms long, until_ms long")
    v = served_view(e, r, c, at=10)
    got = {(x["provider"], x["fact_key"]) for x in v.facts.collect()}
    assert ("q", "rate.input") not in got and ("p", "rate.input") in got and ("p", "limit.temperature_max") not in got  # a withheld slot is not filled
    assert [(x["provider"], x["fact_key"]) for x in v.withheld.collect()] == [("q", "rate.input")] and v.uncertain.count() == 0
    assert ("q", "rate.input") in {(x["provider"], x["fact_key"]) for x in served_view(e, r, c, at=30).facts.collect()}
