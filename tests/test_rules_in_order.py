"""Rule tables with positions: the first valid row of a key stays, and rejected rows condemn nobody."""

from pyspark.sql import functions as F

from factledger.operators import rules


def load(spark, kind, schema, rows, context=None):
    df = spark.createDataFrame(rows, schema)
    for name, value in {"source_ref": "https://x", "quote": "q", "established_at_ms": 1, "review_by_ms": 1 + 60 * rules.DAY}.items():
        df = df if name in df.columns else df.withColumn(name, F.lit(value))
    ok, bad = rules.load_rules(df, rules.specs()[kind], context)
    return sorted(r["pos"] for r in ok.collect()), {r["pos"]: r["reasons"] for r in bad.collect()}


def test_aliases(spark):
    s = "pos int, provider string, model string, target_provider string, target string, basis string, output_limit long, default_effort string, wire_ids map<string,string>"
    rows = [(5, "p", "a", "p", "late", "b"), (1, "p", "a", "p", "r", "b"), (2, "p", "x", "p", "", "b"), (3, "p", "y", "p", "x", "b"), (4, "p", "z", "p", "a", "b"), (6, "p", "c", "p", "z", "b"), (7, "p", "x", "p", "r", None), (8, "p", "s", "p", "s", "b")]
    ok, bad = load(spark, "aliases", s, [(*r, None, None, None) for r in rows])
    # x is no alias, since both of its rows fail, so y may point at it; z is refused, but was there when c was judged
    assert ok == [1, 3] and bad == {5: ["duplicate_key"], 2: ["empty_target"], 4: ["chained_target"], 6: ["chained_target"], 7: ["empty_basis"], 8: ["self_target"]}


def test_speed_twins(spark):
    s = "pos int, provider string, base string, mode string, twin string, label string, api_card string"
    rows = [(1, "a", "fast", "t"), (2, "b", "fast", "t"), (3, "b", "fast", "u"), (4, "b", "fast", "w"), (5, "c", "slow", "v"), (6, "c", "fast", "b"), (7, "d", "fast", "c")]
    ok, bad = load(spark, "speed_twins", s, [(r[0], "p", *r[1:], "l", "p/card") for r in rows])
    assert ok == [1, 3] and bad == {2: ["duplicate_twin"], 4: ["duplicate_key"], 5: ["unknown_mode"], 6: ["twin_is_base"], 7: ["twin_is_base"]}
    for card, fine in (("p/c", True), ("p/x y/z", False), ("a/b/c", False), ("p/", False), ("/c", False), ("p c/d", False)):
        assert (load(spark, "speed_twins", s, [(1, "p", "a", "fast", "t", "l", card)])[0] == [1]) is fine


def test_acceptance_is_that_of_a_loop(spark):
    import random

    r = random.Random(6)
    rows = [(i, "p", r.choice("abcdef"), "fast", r.choice("ABCDEFGH"), "l", "p/card") for i in range(60)]
    taken, twins, want = set(), set(), []
    for pos, _, base, _, twin, *_ in rows:
        if base not in taken and twin not in twins:
            taken.add(base), twins.add(twin), want.append(pos)
    ok, bad = load(spark, "speed_twins", "pos int, provider string, base string, mode string, twin string, label string, api_card string", r.sample(rows, len(rows)))
    assert ok == want and len(bad) == len(rows) - len(want)


def test_creators_keep_the_last(spark):
    ok, bad = load(spark, "creators", "pos int, family string, creator string", [(1, "f", "a"), (2, "f", "b"), (3, "g", ""), (4, "f", " "), (5, "g", "c")])
    assert ok == [2, 5] and bad == {1: ["duplicate_key"], 3: ["empty_creator"], 4: ["empty_creator"]}


def test_held_declined_and_complete(spark):
    ids = lambda cols, *rows: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    ok, bad = load(spark, "held_models", "pos int, provider string, model string, reason string, held_since_ms long", [(1, "p", "m", " ", 1), (2, "p", "m", "r", 1), (3, "p", "m", "r", 1), (4, "p", "n", "r", 1), (5, "p", "o", "r", 0)], {"curated": ids("provider model", ("p", "m"), ("p", "o"))})
    assert ok == [2] and bad == {1: ["empty_reason"], 3: ["duplicate_key"], 4: ["no_curated_row"], 5: ["held_since"]}
    ok, bad = load(spark, "declined_audio", "pos int, provider string, reason string", [(1, "a", "r"), (2, "a", "r"), (3, "b", "r"), (4, "c", "")], {"audio": ids("provider", ("b",))})
    assert ok == [1] and bad == {2: ["duplicate_key"], 3: ["declined_and_listed"], 4: ["empty_reason"]}
    fixes = spark.createDataFrame([("a", "m", False, "s"), ("b", "*", False, "s"), ("c", "m", True, "s"), ("d", "m", False, "other")], "provider string, model string, withheld boolean, source_ref string")
    s = "pos int, provider string, fact_key string, notes string, commit string, source_ref string"
    rows = [(i, p, "wire.api", "read at c0", "c0", "s") for i, p in enumerate("abcd")] + [(4, "a", "wire.api", "read at c0", "c0", "s"), (5, "e", "wire.npm", "nothing", "c0", "s")]
    ok, bad = load(spark, "complete_providers", s, rows, rules.complete_context(fixes, spark.createDataFrame(rows, s)))
    assert ok == [0] and bad == {1: ["default_beside_list"], 2: ["no_routed_model"], 3: ["other_source"], 4: ["duplicate_key"], 5: ["field", "notes_without_commit", "no_routed_model"]}


def test_every_kind_takes_an_empty_table(spark):
    df = spark.createDataFrame([], "pos int, family string, creator string")
    assert [x.count() for x in rules.load_rules(df, rules.specs()["creators"])] == [0, 0]
    twins = spark.createDataFrame([], "pos int, provider string, base string, mode string, twin string, label string, api_card string, source_ref string, quote string, established_at_ms long, review_by_ms long")
    assert [x.count() for x in rules.load_rules(twins, rules.specs()["speed_twins"])] == [0, 0]
