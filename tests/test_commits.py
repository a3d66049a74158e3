"""Commits of several tables, compaction, ids, and polls that run again, break off or meet errors of the system."""

import json
import os

import pytest
from pyspark.sql import functions as F

from factledger.sources import documents, tables
from factledger.streaming import capture

FACT = "provider string, model string, fact_key string, value_json string"


def test_a_commit_is_all_or_nothing_and_happens_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ledger")
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("u",), ("v",)], "y string")
    count = lambda t: tables.read_or_empty(spark, f"{root}/{t}", "x int").count()
    with monkeypatch.context() as m:
        m.setattr(tables, "_mark", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
        with pytest.raises(OSError):
            tables.commit(spark, root, {"a": a, "b": b}, 1, "s/0")
    assert (count("a"), count("b")) == (0, 0)  # the data of both lies there, unread
    assert tables.commit(spark, root, {"a": a, "b": b}, 1, "s/0")
    assert not tables.commit(spark, root, {"a": a, "b": b}, 2, "s/0")
    assert tables.commit(spark, root, {"a": a}, 3, "s/1") and tables.commit(spark, root, {"a": a}, 4)
    assert (count("a"), count("b")) == (3, 2)


def test_compaction_keeps_the_rows_and_names_one_batch(spark, tmp_path):
    root = str(tmp_path / "ledger")
    for i in range(4):
        tables.commit(spark, root, {"a": spark.createDataFrame([(i,)], "x int")}, i)
    tables.append_batch(spark.createDataFrame([(9,)], "x int"), f"{root}/a", 5)
    assert len(tables.live_batches(spark, f"{root}/a")) == 5
    new = tables.compact(spark, f"{root}/a", 6, ["x"])
    assert tables.live_batches(spark, f"{root}/a") == [new] and tables.compact(spark, f"{root}/a", 7, ["x"]) is None
    tables.commit(spark, root, {"a": spark.createDataFrame([(10,)], "x int")}, 8)
    assert sorted(r["x"] for r in tables.read_table(spark, f"{root}/a").collect()) == [0, 1, 2, 3, 9, 10]


def test_ids_of_polls_do_not_meet(spark):
    """Over more tasks than a plain shift leaves room for."""
    obs = spark.createDataFrame([], tables.OBSERVATION)
    facts = spark.range(3000).select(F.lit("s").alias("source"), F.format_string("p%05d", "id").alias("provider"), F.lit("m").alias("model"), F.lit("f").alias("fact_key"), F.lit("1").alias("value_json"), F.lit(1).cast("long").alias("boundary"), F.lit("seed").alias("kind"))
    kind = {f.split()[0]: f.split()[1] for f in tables.ERA.split(", ")}
    facts = facts.select(*[F.col(c) if c in facts.columns else F.lit(None).cast(t).alias(c) for c, t in kind.items()])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ids = [[r["id"] for r in tables.era_rows(facts, obs, tables.poll_ids(n)).orderBy("provider").collect()] for n in (0, 1, 2)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(a < b for polls in ids for a, b in zip(polls, polls[1:])) and ids[0][-1] < ids[1][0] and ids[1][-1] < ids[2][0]
    assert ids[0][-1] >> tables.ROW_BITS >= 128
    with pytest.raises(ValueError):
        tables.poll_ids(1 << 19)


def _doc(price, models):
    return json.dumps({"p": {"name": "P", "models": {m: {"family": "f", "cost": {"input": price}} for m in models}}})


@pytest.fixture
def poll(spark, tmp_path):
    (tmp_path / "in").mkdir()
    clock = iter(range(100, 10_000, 100))

    def land(n, text):
        (tmp_path / "in" / f"{n}.json").write_text(text)
        os.utime(tmp_path / "in" / f"{n}.json", (n, n))

    def run(parse=None):
        facts = lambda raw: documents.to_facts(documents.normalise_models(documents.parse_documents(raw)))
        q = capture.poll_stream(spark, str(tmp_path / "in"), str(tmp_path / "eras"), "src", str(tmp_path / "polls"), str(tmp_path / "cp"), lambda: next(clock), parse or facts)
        try:
            q.awaitTermination(300)
        except Exception as e:
            return e
        return q.exception()

    def state():
        rows = lambda t, s, c: sorted(tuple(r) for r in tables.read_or_empty(spark, str(tmp_path / t), s).select(*c).collect())
        return rows("polls", tables.OBSERVATION, ("id", "outcome", "failure_class")), rows("eras", tables.ERA, ("id", "model", "fact_key", "value_json", "observation_id"))

    return land, run, state, tmp_path


def test_a_poll_that_runs_again_writes_nothing(poll):
    land, run, state, path = poll
    land(0, _doc(1, "ab"))
    land(1, _doc(2, "ab"))
    assert run() is None
    polls, eras = state()
    assert [p[1] for p in polls] == ["changed", "changed"] and len({e[0] for e in eras}) == len(eras) and {e[4] for e in eras} == {1, 2}
    (path / "cp" / "commits" / "1").unlink()  # as if the process had died after the sink and before the stream's own commit
    for crc in (path / "cp" / "commits").glob(".1.crc"):
        crc.unlink()
    assert run() is None and state() == (polls, eras)


def test_a_poll_that_breaks_off_leaves_both_tables(poll, monkeypatch):
    land, run, state, _ = poll
    land(0, _doc(1, "ab"))
    assert run() is None
    before = state()
    land(1, _doc(2, "ab"))
    with monkeypatch.context() as m:
        m.setattr(tables, "_mark", lambda *a: (_ for _ in ()).throw(OSError("the process dies here")))
        assert run() is not None
    assert state() == before
    assert run() is None
    polls, eras = state()
    assert [p[1] for p in polls] == ["changed", "changed"] and len(eras) == len(before[1]) + 2


def test_an_error_of_the_system_is_no_failed_poll(poll):
    land, run, state, _ = poll
    land(0, _doc(1, "ab"))
    facts = lambda raw: documents.to_facts(documents.normalise_models(documents.parse_documents(raw)))
    broken = lambda raw: facts(raw).withColumn("value_json", F.raise_error(F.lit("disk full")))
    assert "disk full" in str(run(broken)) and state() == ([], [])
    assert run() is None and [p[1] for p in state()[0]] == ["changed"]  # the file was not lost
    land(1, "{ no document")
    land(2, "[1]")
    assert run() is None and [p[1:] for p in state()[0]][1:] == [("failed", "parse"), ("failed", "parse")]
