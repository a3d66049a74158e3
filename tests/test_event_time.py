"""Capture in any order against the batch operator, late rows, and a source that stops."""

import os
import random
import time

from factledger.operators.asof import changes
from factledger.streaming import event_time

S = "key string, value_json string, boundary long, id long"


def land(spark, folder, n, rows):
    """One file a micro-batch, in the order of n."""
    spark.createDataFrame(rows, S).coalesce(1).write.parquet(f"{folder}/tmp{n}")
    part = next(p for p in os.listdir(f"{folder}/tmp{n}") if p.startswith("part"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{folder}/tmp{n}/{part}", f"{folder}/in/{n:03d}.parquet")
    os.utime(f"{folder}/in/{n:03d}.parquet", (n + 1, n + 1))


def capture(spark, folder, delay):
    got = []
    stream = spark.readStream.schema(S).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = event_time.run_with_state(event_time.capture_in_any_order(stream, delay), f"{folder}/cp").foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return got


def test_rows_in_any_order(spark, tmp_path):
    r = random.Random(8)
    rows = [(k, r.choice(["1", "2", " 2", '{"b":1,"a":2}', '{"a": 2, "b": 1}', "null"]), 1000 * t, 10 * t) for k in "abc" for t in range(1, 30)]
    mixed = r.sample(rows, len(rows))
    for n in range(3):
        land(spark, str(tmp_path), n, mixed[n::3])
    land(spark, str(tmp_path), 3, [("end", "0", 10_000_000, 1)])  # moves the watermark past the rest
    got = capture(spark, str(tmp_path), "1 hour")
    want = changes(spark.createDataFrame(rows, S), ["key"]).select("key", "value_json", "boundary").collect()
    assert sorted((x["key"], x["value_json"], x["boundary"]) for x in got if x["key"] != "end") == sorted(map(tuple, want))
    assert all(x["kind"] == ("asserted" if x["prior_ms"] is None else "observed") for x in got)
    # each change lies after the last confirmation before it
    times = {k: sorted(b for g, _, b, _ in rows if g == k) for k in "abc"}
    assert all(x["prior_ms"] == max([b for b in times[x["key"]] if b < x["boundary"]], default=None) for x in got if x["key"] != "end")


def test_a_row_behind_the_watermark_is_late(spark, tmp_path):
    land(spark, str(tmp_path), 0, [("a", "1", 1_000, 1), ("a", "2", 5_000, 2)])
    land(spark, str(tmp_path), 1, [("x", "0", 9_000_000, 3)])
    land(spark, str(tmp_path), 2, [("a", "3", 3_000, 4), ("a", "3", 9_500_000, 5)])
    land(spark, str(tmp_path), 3, [("x", "0", 99_000_000, 6)])
    got = sorted((x["key"], x["boundary"], x["value_json"], x["prior_ms"], x["kind"]) for x in capture(spark, str(tmp_path), "10 seconds") if x["key"] == "a")
    assert got == [("a", 1_000, "1", None, "asserted"), ("a", 3_000, "3", None, "late"), ("a", 5_000, "2", 1_000, "observed"), ("a", 9_500_000, "3", 5_000, "observed")]


def test_a_source_that_stops_turns_silent_by_itself(spark, tmp_path):
    got = []
    spark.createDataFrame([("s",)], "source string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string").parquet(str(tmp_path / "in"))
    q = event_time.run_with_state(event_time.watch_silence(stream, 3_000), str(tmp_path / "cp")).outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            if [x["status"] for x in got][-1:] == ["silent"]:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert [(x["source"], x["status"]) for x in got] == [("s", "heard"), ("s", "silent")] and got[1]["at_ms"] - got[0]["at_ms"] == 3_000
