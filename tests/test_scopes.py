"""A scoped view is the whole view, filtered: for every provider and every model."""

import pytest

from factledger.operators import layers, ledger
from factledger.plans.view import Plane, Rules, read_scope, served_view

E = "provider string, model string, fact_key string, value_json string, boundary long, id long, prior_ms long"


@pytest.fixture(scope="module")
def world(spark):
    def entity(p, m, **facts):
        return [(p, m, k.replace("_", ".", 1), v, 1, 1, None) for k, v in {"existence": '"present"', **facts}.items()]

    price = lambda n: f'{{"state":"priced","units":{n}}}'
    rows = entity("maker", "m", model_family='"f"', rate_input=price(1)) + entity("r", "m", model_family='"f"', model_open_weights="true")
    rows += entity("maker", "far", model_family='"f"', rate_input=price(9)) + entity("s", "far", model_family='"f"', model_open_weights="true")
    rows += entity("a", "base", rate_input=price(2)) + entity("a", "twin", rate_input=price(3)) + entity("x", "m", rate_input=price(7)) + entity("a", "alone", limit_context="5")
    eras = spark.createDataFrame(rows, E).cache()
    rules = Rules(
        creators=spark.createDataFrame([("f", "maker")], "family string, creator string"),
        aliases=spark.createDataFrame([("r", "al", "s", "far"), ("a", "fast-al", "a", "base"), ("a", "twin2", "s", "far")], "provider string, model string, target_provider string, target string"),
        twins=spark.createDataFrame([("a", "base", "fast", "twin", "Fast"), ("a", "alone", "fast", "twin2", "Two")], "provider string, base string, mode string, twin string, label string"),
        retired=spark.createDataFrame([("gone", "m", None), ("r", "old", "m")], "provider string, model string, successor string"),
    )
    whole = [tuple(r) for r in served_view(eras, rules).facts.collect()]
    return eras, rules, whole


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_scope(world):
    eras, rules, whole = world
    facts = {r[:3]: r[3] for r in whole}
    assert ("r", "al", "rate.input") in facts and ("a", "base", "rate.input.mode.fast") in facts and ("a", "alone", "rate.input.mode.fast") in facts
    providers, models = sorted({r[0] for r in whole}) + ["none"], sorted({r[1] for r in whole})
    scopes = [(p, None) for p in providers] + [(None, m) for m in models] + sorted({r[:2] for r in whole if r[1] in ("al", "alone", "base", "m")})
    for provider, model in scopes:
        want = sorted(r for r in whole if (provider is None or r[0] == provider) and (model is None or r[1] == model))
        assert rows_of(served_view(eras, rules, provider=provider, model=model).facts) == want, (provider, model)


def test_rows_of_rule_tables_stay_in_the_scope(world):
    eras, rules, _ = world
    got = served_view(eras, rules, provider="r", include_retired=True).facts
    assert {r["provider"] for r in got.collect()} == {"r"} and ("r", "old", "existence", '"absent"') in rows_of(got)


def test_a_borrowed_plane_reads_its_lender(spark, world):
    eras, _, _ = world
    links = Rules(links=spark.createDataFrame([("a", "base", '"x/m"')], "provider string, model string, value string"))
    plane = Plane("a", "oauth", "quota_proxy", rates_from="x")
    whole = rows_of(served_view(eras, links, plane=plane).facts)
    assert rows_of(served_view(eras, links, provider="a", plane=plane).facts) == whole and any('"units":7' in r[3] for r in whole)


def test_the_rest_of_the_ledger_is_not_read(world):
    eras, rules, _ = world
    got = read_scope(eras, rules, "r", None)
    assert {(r["provider"], r["model"]) for r in got.select("provider", "model").distinct().collect()} == {("r", "m"), ("maker", "m"), ("maker", "far"), ("s", "far")}
    one = read_scope(eras, rules, "a", "alone")
    assert {(r["provider"], r["model"]) for r in one.select("provider", "model").distinct().collect()} == {("a", "alone"), ("s", "far"), ("maker", "far")}
    assert got.count() == got.distinct().count() and read_scope(eras, Rules(), None, None) is eras
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Cross" not in plan


def test_an_override_is_decided_by_its_key(spark):
    """An addition never goes over a stored value, null included; a replaced null must be stored."""
    facts = {("p", "null"): {"capability.reasoning_default": "null", "model.status": "null", "rate.output_image": "null"}, ("p", "none"): {"limit.context": "1"}}
    e = spark.createDataFrame([(*k, v) for k, v in facts.items()], "provider string, model string, facts map<string,string>")
    o = [(m, k, v, None) for m in ("null", "none") for k, v in (("model.status", '"deprecated"'), ("rate.output_image", "1"), ("capability.server_side_fallback", "true"))]
    o = spark.createDataFrame([("p", *r) for r in o], "provider string, model string, fact_key string, value string, replaces string")
    got = {r["model"]: dict(r["overridden"]) for r in layers.apply_overrides(e, o).collect()}
    assert got == {"null": {"model.status": '"deprecated"', "capability.server_side_fallback": "true"}, "none": {"rate.output_image": "1", "capability.server_side_fallback": "true"}}


def test_the_order_of_states_of_a_feed(spark):
    hour = 3_600_000
    s = "id long, source string, observed_at_ms long, outcome string, failure_class string"
    failed = lambda name, n, start: [(10 + i, name, start + i, "failed", "network") for i in range(n)]
    rows = [(1, "old and failing", 90 * hour, "changed", None), *failed("old and failing", 5, 100 * hour - 9)]
    rows += failed("new", 1, 100 * hour - 9) + failed("never", 4, 100 * hour - 9) + [(1, "failing", 99 * hour, "changed", None), *failed("failing", 4, 100 * hour - 9)]
    rows += [(i, "quiet and unwritten", 50 * hour + i, "unrecorded", None) for i in range(2)]
    got = {r["source"]: r["status"] for r in ledger.freshness(spark.createDataFrame(rows, s), 100 * hour, ["source"]).collect()}
    assert got == {"old and failing": "stale", "new": "fresh", "never": "failing", "failing": "failing", "quiet and unwritten": "unrecorded"}
