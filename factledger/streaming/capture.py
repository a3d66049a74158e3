"""Streams: change capture with state, polls and releases in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factledger.functions.claims import canonical

OUT = StructType([StructField("key", StringType()), StructField("value_json", StringType()), StructField("boundary", LongType()), StructField("prior_ms", LongType())])
_STATE = StructType([StructField("value_json", StringType()), StructField("seen_ms", LongType())])


class _Capture(StatefulProcessor):
    """One state row per fact: its claim (canonical) and when it was last confirmed. The state never expires, since a fact stays in force."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        got = sorted((int(t), int(i), v, c) for pdf in rows for t, i, v, c in zip(pdf["boundary"], pdf["id"], pdf["value_json"], pdf["claim"]))
        value, seen = self.held.get() if self.held.exists() else (None, None)
        out = []
        for t, _, v, claim in got:
            if seen is None or claim != value:
                out.append((key[0], v, t, seen))
            value, seen = claim, t
        self.held.update((value, seen))
        yield pd.DataFrame({"key": [o[0] for o in out], "value_json": [o[1] for o in out], "boundary": pd.array([o[2] for o in out], dtype="Int64"), "prior_ms": pd.array([pd.NA if o[3] is None else o[3] for o in out], dtype="Int64")})

    def close(self) -> None:
        pass


def capture_changes(stream: DataFrame) -> DataFrame:
    """stream(key, value_json, boundary, id) -> an era for each change of a key's claim: (key, value_json, boundary, prior_ms),
    prior_ms being the last confirmation before it. The source must deliver a key's rows in order from batch to batch;
    inside a batch they are sorted (a key's rows of one batch are held at once). Claims are compared by what they say, not by how they
    are written. Needs the RocksDB state store."""
    return stream.withColumn("claim", canonical(F.col("value_json"))).groupBy("key").transformWithStateInPandas(_Capture(), OUT, "Append", "None")


def start_capture(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs the capture over all that is there now."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return capture_changes(stream).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll_batch(current: DataFrame, incoming: DataFrame, entity: list[str], held_digest: str | None = None) -> tuple[str, DataFrame | None]:
    """One poll inside foreachBatch: (outcome, plan). Unchanged by digest, refused by the shrink guard, or the eras to append."""
    from factledger.operators.diff import facts_digest, plan_ingest, shrink_guard, state_digest

    digest = state_digest(facts_digest(incoming, entity), entity).first()["digest"]
    if digest == held_digest:
        return "unchanged", None
    if shrink_guard(current.select(*entity).distinct(), incoming.select(*entity).distinct()).first()["refused"]:
        return "failed", None
    return "changed", plan_ingest(current, incoming, entity)


def apply_releases(state: DataFrame, ops: DataFrame, last_release: int) -> DataFrame:
    """The state after new releases, applied in order in one pass; a gap in their numbers is an error."""
    from factledger.operators.diff import replay_chain

    span = ops.where(F.col("release") > last_release).agg(F.min("release").alias("lo"), F.max("release").alias("hi"), F.count_distinct("release").alias("n")).first()
    if span["n"] and (span["lo"] != last_release + 1 or span["hi"] - span["lo"] + 1 != span["n"]):
        raise ValueError("a release is missing")
    return replay_chain(state, ops.where(F.col("release") > last_release), ["provider", "model", "fact_key"], ["release", "pos"])


def _query_id(spark, checkpoint: str) -> str:
    """Of the stream whose micro-batch runs now; it outlives restarts from the same checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint


def poll_stream(spark, folder: str, ledger: str, source: str, observations: str, checkpoint: str, clock: Callable[[], int], parse: Callable[[DataFrame], DataFrame], refused: Callable[[Exception], bool] | None = None):
    """The poll of a source as a stream: each file that lands in `folder` is one document and one observation. parse(file, value) gives its
    facts (provider, model, fact_key, value_json). The observation's outcome is not_modified (the same bytes as the last document),
    unchanged (the same facts by digest), changed (eras are appended to the ledger) or failed, with a class: parse (refused(error) says
    that the document can't be read; any other error stops the stream, and the file stays unread) or implausible (too much would go).
    Until a new process has read one document it doesn't trust the saved digest alone, so the first document is always compared in
    full. Runs over all that is there now, file by file, in the order of their names.

    `ledger` and `observations` are tables in one folder. An observation and its eras are one commit under (stream, micro-batch, file): a
    micro-batch that runs again writes nothing, and one that broke off has left nothing that is read. A document's text stays with the
    executors; the driver sees its name and digests."""
    from factledger.operators.asof import current
    from factledger.operators.diff import facts_digest, state_digest
    from factledger.sources import documents
    from factledger.sources.tables import ERA, OBSERVATION, commit, era_rows, is_committed, poll_ids, read_or_empty

    entity, trusted, refused = ["provider", "model"], {"yes": False}, refused or documents.refused
    (root, _, eras_name), (other, _, polls_name) = ledger.rstrip("/").rpartition("/"), observations.rstrip("/").rpartition("/")
    if root != other:
        raise ValueError("tables of one commit lie in one folder")

    def observe(file: str, raw: DataFrame, key: str) -> None:
        if is_committed(spark, root, key):
            return
        now = clock()
        held = read_or_empty(spark, observations, OBSERVATION)
        last = held.where(F.col("source") == source).where("normalized_hash IS NOT NULL").orderBy(F.desc("observed_at_ms"), F.desc("id")).limit(1).collect()
        raw_hash = raw.select(F.sha2("value", 256)).first()[0]
        outcome, failure, digest, eras, facts = "changed", None, last[0]["normalized_hash"] if last else None, None, None
        if trusted["yes"] and last and last[0]["raw_hash"] == raw_hash:
            outcome = "not_modified"
        else:
            try:
                facts = parse(raw).persist()
                digest = state_digest(facts_digest(facts, entity), entity).first()["digest"]
            except Exception as e:
                if not refused(e):
                    raise
                outcome, failure, digest = "failed", "parse", None
            if outcome != "failed":
                told = read_or_empty(spark, ledger, ERA).where(F.col("source") == source)
                now_held = current(told.select(*entity, "fact_key", "value_json", "boundary", "id"), [*entity, "fact_key"])
                outcome, eras = poll_batch(now_held, facts, entity, last[0]["normalized_hash"] if last and trusted["yes"] else None)
                if outcome == "changed" and eras.isEmpty():
                    outcome = "unchanged"
                failure, trusted["yes"] = ("implausible" if outcome == "failed" else None), outcome != "failed"
        n = (held.agg(F.max("id")).first()[0] or 0) + 1
        row = (n, source, now, outcome, failure, file, digest if outcome != "failed" else None, raw_hash, None, None)
        parts = {polls_name: spark.createDataFrame([row], OBSERVATION)}
        if outcome == "changed":
            first = not last
            base = eras.select(F.lit(source).alias("source"), *entity, "fact_key", "value_json", F.lit(now).cast("long").alias("boundary"), F.lit("asserted" if first else "observed").alias("kind"), F.lit(n).cast("long").alias("observation_id"))
            kind = {f.split()[0]: f.split()[1] for f in ERA.split(", ")}
            base = base.select(*[F.col(c) if c in base.columns else F.lit(None).cast(t).alias(c) for c, t in kind.items()])
            parts[eras_name] = era_rows(base, held, poll_ids(n))
        commit(spark, root, parts, now, key)
        if facts is not None:
            facts.unpersist()

    def batch(df: DataFrame, micro: int) -> None:
        stream = _query_id(spark, checkpoint)
        for r in df.select("file").orderBy("file").collect():  # as many as maxFilesPerTrigger; a file is a poll, one after another
            observe(r["file"], df.where(F.col("file") == r["file"]), f"{stream}/{micro}/{r['file']}")

    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 1).load(folder)
    return files.select(F.col("_metadata.file_path").alias("file"), "value").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
