"""Layers over tables as large as the entities: what is computed once, what is not sent whole to every task."""

from pyspark.sql import functions as F

from factledger.operators import layers

RATE = '{"state":"priced","units":%d,"exponent":9}'


def plan_of(df, optimized=True):
    q = df._jdf.queryExecution()
    return (q.optimizedPlan() if optimized else q.sparkPlan()).toString()


def lifetimes(spark):
    rows = [("p", str(n), {"rate.input": RATE % (4 * n), "rate.cache_write": RATE % (5 * n), "limit.context": "1"}) for n in (1, 2)]
    e = spark.createDataFrame(rows, "provider string, model string, facts map<string,string>")
    rules = spark.createDataFrame([("p", "1", ["5m"], [("5m", 5, 4)])], "provider string, model string, lifetimes array<string>, ratios array<struct<ttl:string,num:int,den:int>>")
    return layers.unfold(layers.apply_lifetimes(e, rules))


def test_prices_of_lifetimes_are_read_once(spark):
    out = lifetimes(spark)
    got = {(r["model"], r["fact_key"]): r["value_json"] for r in out.collect() if r["fact_key"].startswith(("rate.cache_write.", "capability."))}
    assert got == {("1", "rate.cache_write.ttl.5m"): RATE % 5, ("1", "capability.cache_lifetimes"): '["5m"]'}
    plan = plan_of(out)
    assert "Filter (size(" not in plan and plan.count("get_json_object") <= 16  # two amounts, in one place


def test_rules_of_entities_are_not_broadcast(spark):
    assert "Broadcast" not in plan_of(lifetimes(spark), optimized=False)


def test_an_entity_without_facts_unfolds_to_nothing(spark):
    e = spark.createDataFrame([("p", "a", {}), ("p", "b", None), ("p", "c", {"k": None})], "provider string, model string, facts map<string,string>")
    assert [tuple(r) for r in layers.unfold(e).collect()] == [("p", "c", "k", None)]


def test_a_map_set_by_an_expression_computes_it_once(spark):
    from factledger.functions.claims import put_all

    e = spark.createDataFrame([({"a": "1", "b": "2"},), ({},)], "facts map<string,string>")
    new = F.map_from_entries(F.transform(F.map_entries("facts"), lambda x: F.struct(F.upper(x["key"]), F.get_json_object(x["value"], "$"))))
    out = e.select(put_all(F.col("facts"), new).alias("m"))
    assert [r["m"] for r in out.collect()] == [{"a": "1", "b": "2", "A": "1", "B": "2"}, {}] and plan_of(out).count("get_json_object") == 1


def test_a_dated_view_sends_no_table_of_entities_to_every_task(spark):
    from conftest import SF

    from factledger.plans.queries import QUERIES

    joins = [line for line in plan_of(QUERIES["served_dated"](spark, SF), optimized=False).splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "model#" in line or "key#" in line]


ERA = "provider string, model string, fact_key string, value_json string, boundary long, id long"


def test_facts_are_folded_behind_one_shuffle(spark):
    from factledger.plans.view import states

    e = spark.createDataFrame([("p", "m", "k", "1", 1, 1)], ERA)
    fix = spark.createDataFrame([("p", "m", "k")], "provider string, model string, fact_key string")
    for df in (states(e, None), states(e, 1), states(e, 1, fix)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange ") == 1 and "Join" not in plan and "Sort" not in plan[plan.index("Exchange ") :]


def test_states_with_corrections(spark):
    from factledger.plans.view import states

    rows = [("p", "m", "a", "1", 1, 1), ("p", "m", "a", "2", 5, 2), ("p", "m", "b", "3", 1, 1), ("p", "m", "c", "4", 9, 1), ("p", None, "a", "5", 1, 1), ("q", "n", "a", "6", 1, 1)]
    fix = spark.createDataFrame([("p", "m", "b"), ("p", "m", "b"), ("p", "m", "c"), ("p", None, "a"), ("p", "never", "a")], "provider string, model string, fact_key string")
    got = {(r["provider"], r["model"]): (dict(r["facts"]), list(r["withheld"])) for r in states(spark.createDataFrame(rows, ERA), 5, fix).collect()}
    assert got == {("p", "m"): ({"a": "2"}, ["b"]), ("p", None): ({"a": "5"}, []), ("q", "n"): ({"a": "6"}, [])}


def test_rules_of_a_plane_are_computed_once(spark):
    e = spark.createDataFrame([("p", "m", {"rate.a": "1", "rate.b": "2"})], "provider string, model string, facts map<string,string>")
    rules = spark.createDataFrame([("p", "c", "billed_as", "a", None), ("p", "d", "not_established", None, None)], "provider string, class string, action string, target string, model_ids array<string>")
    out = layers.unfold(layers.apply_plane(e, rules, keep_published=False), "ruled")
    got = {r["fact_key"]: (r["value_json"], r["fact_key"] in r["ruled"]) for r in out.collect()}
    assert got == {"rate.a": ("1", False), "rate.b": ("2", False), "rate.c": ('{"key":"rate.a","state":"billed_as"}', True), "rate.d": (layers.NOT_ESTABLISHED, True)}
    assert plan_of(out).count(layers.NOT_ESTABLISHED) == 1


PLANE = "provider string, class string, action string, target string, model_ids array<string>"


def test_rules_of_a_plane_neither_look_keys_up_by_exceptions_nor_write_json_for_each_entity(spark):
    e = spark.createDataFrame([("p", "m", {"rate.a": "1"})], "provider string, model string, facts map<string,string>")
    plan = plan_of(layers.apply_plane(e, spark.createDataFrame([("p", "c", "billed_as", "a", ["m"])], PLANE), keep_published=True))
    assert "array_contains" not in plan and "map_contains_key" not in plan
    assert plan.count("StructsToJson") == 2  # one for a rule, one for a tier of an entity that has tiers


def test_tiers_of_a_plane(spark):
    e = spark.createDataFrame([("p", "m", {"rate.a.above_context.9": "1", "rate.b": "2", "rate.b.above_context.7": None, "rate.b.above_context.9": "4", "rate.b.above_context.x": "5", "rate.bb.above_context.3": "6"}), ("q", "m", {"rate.b": "2"})], "provider string, model string, facts map<string,string>")
    rules = spark.createDataFrame([("p", "a", "billed_as", "b", None), ("p", "c", "not_established", "b", ["m", "n"]), ("p", "d", "stated_zero", None, ["n"]), ("p", "e", "billed_as", None, None)], PLANE)
    billed = lambda t: '{"key":"rate.b%s","state":"billed_as"}' % t
    said = {"rate.a": billed(""), "rate.a.above_context.7": billed(".above_context.7"), "rate.a.above_context.9": billed(".above_context.9"), "rate.c": layers.NOT_ESTABLISHED, "rate.e": layers.NOT_ESTABLISHED}
    facts = {(r["provider"], r["model"]): r["facts"] for r in e.collect()}
    for keep in (False, True):
        given = {k: v for k, v in said.items() if not keep or k not in facts["p", "m"]}
        got = {r["provider"]: (r["ruled"], r["facts"]) for r in layers.apply_plane(e, rules, keep).collect()}
        assert got == {"p": (given, facts["p", "m"] | given), "q": ({}, facts["q", "m"])}


def test_line_items_of_a_plane_are_grouped_without_sorting(spark):
    from conftest import SF

    from factledger.plans.queries import QUERIES

    assert "SortAggregate" not in plan_of(QUERIES["plane_rules"](spark, SF), optimized=False)


def test_line_items_without_flag_or_amounts_follow_the_plane(spark, tmp_path):
    import duckdb

    from factledger.plans.queries import ORACLES, QUERIES

    rows = [(1, 1, 5.0, 0.1, 9.0, None), (1, 2, None, 0.1, 9.0, "A"), (1, 3, 5.0, None, 9.0, ""), (1, 3, 7.0, None, None, "NR"), (2, 4, None, None, None, None)]
    t = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double, l_extendedprice double, l_returnflag string")
    t.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert {tuple(r) for r in QUERIES["plane_rules"](spark, str(tmp_path)).collect()} == set(con.execute(ORACLES["plane_rules"]).fetchall())
