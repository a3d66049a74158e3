"""Ledger tables on Parquet: append-only, a batch is visible only through its commit marker; a commit may hold batches of several tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.operators.asof import as_of

ERA = "id LONG, source STRING, provider STRING, model STRING, fact_key STRING, value_json STRING, boundary LONG, kind STRING, prior_ms LONG, observation_id LONG, from_ms LONG, until_ms LONG, reason STRING"
OBSERVATION = "id LONG, source STRING, observed_at_ms LONG, outcome STRING, failure_class STRING, detail STRING, normalized_hash STRING, raw_hash STRING, etag STRING, duration_ms LONG"
MARKER = "batch STRING, committed_at_ms LONG, rows LONG, table_name STRING, commit_key STRING, replaces ARRAY<STRING>"
#: Bits of an era's id: its row in a task, its task, and its poll before them.
ROW_BITS, TASK_BITS = 28, 16


def _split(path: str) -> tuple[str, str]:
    folder, _, name = path.rstrip("/").rpartition("/")
    return folder, name


def _read_markers(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MARKER).parquet(f"{path}/commits")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MARKER)


def _markers(spark: SparkSession, path: str) -> DataFrame:
    """Commit markers of a table: its own, and those in the log of the ledger whose folder it lies in."""
    folder, name = _split(path)
    return _read_markers(spark, path).unionByName(_read_markers(spark, folder).where(F.col("table_name") == name))


def _write_data(df: DataFrame, path: str) -> tuple[str, int]:
    batch = uuid.uuid4().hex
    df.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/data")
    return batch, df.sparkSession.read.schema("batch STRING").parquet(f"{path}/data").where(F.col("batch") == batch).count()


def _mark(spark: SparkSession, path: str, markers: list[tuple]) -> None:
    """All markers of one commit in one file, which appears whole or not at all."""
    spark.createDataFrame(markers, MARKER).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append_batch(df: DataFrame, path: str, now: int) -> str:
    """Data first, marker last: readers never see half a batch, and a failed one leaves nothing they look at."""
    batch, rows = _write_data(df, path)
    _mark(df.sparkSession, path, [(batch, now, rows, None, None, None)])
    return batch


def is_committed(spark: SparkSession, ledger: str, key: str) -> bool:
    return not _read_markers(spark, ledger).where(F.col("commit_key") == key).isEmpty()


def commit(spark: SparkSession, ledger: str, tables: dict[str, DataFrame], now: int, key: str | None = None) -> bool:
    """Rows for several tables of a ledger (folders in its folder) at once: the data of all first, then one file of markers, so readers see
    all of it or nothing. A commit whose key (of a stream and its micro-batch, say) is in the log already writes nothing and returns
    False; one that broke off before its markers has left nothing that is read and may run again. One writer at a time for a ledger."""
    if key is not None and is_committed(spark, ledger, key):
        return False
    found = [(*_write_data(df, f"{ledger}/{name}"), name) for name, df in tables.items()]
    _mark(spark, ledger, [(batch, now, rows, name, key, None) for batch, rows, name in found])
    return True


def live_batches(spark: SparkSession, path: str) -> list[str]:
    """Committed batches of a table but those that a compacted one stands for: one name per write since the last compaction."""
    gone = F.explode("replaces").alias("batch")
    marks = _markers(spark, path)
    return [r["batch"] for r in marks.select("batch").distinct().join(marks.select(gone).distinct(), "batch", "left_anti").orderBy("batch").toLocalIterator()]


def compact(spark: SparkSession, path: str, now: int, order: list[str]) -> str | None:
    """All live batches of a table as one, dealt in ranges of `order`; its marker names those that it stands for, so the switch is one file.
    Tables of fewer than two batches are left alone."""
    names = live_batches(spark, path)
    if len(names) < 2:
        return None
    batch, rows = _write_data(read_table(spark, path).repartitionByRange(*order).sortWithinPartitions(*order), path)
    _mark(spark, path, [(batch, now, rows, None, None, names)])
    return batch


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of committed batches: these are listed (one row per write since the last compaction) and named to the scan, so uncommitted
    folders are pruned, not read."""
    return spark.read.parquet(f"{path}/data").where(F.col("batch").isin(live_batches(spark, path))).drop("batch")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of the schema where none is there yet."""
    try:
        return read_table(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_eras(spark: SparkSession, path: str, source: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Eras of a source and a closed range of providers. Batches are written in ranges of (provider, model, fact_key), so both filters
    reach the scan and skip files and row groups by their statistics."""
    rows = read_table(spark, path).where(F.col("source") == source)
    rows = rows if low is None else rows.where(F.col("provider") >= low)
    return rows if high is None else rows.where(F.col("provider") <= high)


def row_ids(first_id: int) -> Column:
    """first_id and on: unique and rising in the order of tasks and their rows, not dense, so no task sees all rows. They stay below
    first_id + 2^(ROW_BITS + TASK_BITS); more rows or tasks than that stop the job."""
    at = F.monotonically_increasing_id()
    task, row = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    fits = (task < (1 << TASK_BITS)) & (row < (1 << ROW_BITS))
    return F.when(fits, F.shiftleft(task, ROW_BITS) + row + first_id).otherwise(F.raise_error(F.lit("too many rows or tasks for one batch of ids")).cast("long"))


def poll_ids(n: int) -> int:
    """The first id of the eras of poll n; those of the seed are poll 0's."""
    if not 0 <= n < 1 << (63 - ROW_BITS - TASK_BITS):
        raise ValueError("polls have run out of ids")
    return n << (ROW_BITS + TASK_BITS)


def era_rows(eras: DataFrame, observations: DataFrame, first_id: int) -> DataFrame:
    """Eras as they are stored: observed ones get the last confirming poll of their source before the boundary as prior_ms, and one without
    any stops the job. Ids go on from first_id in the order of the keys."""
    from factledger.operators.ledger import CONFIRMING

    ok = observations.where(F.col("outcome").isin(*CONFIRMING)).select("source", F.col("observed_at_ms").alias("_at"))
    prior = eras.where("kind = 'observed'").select("source", "boundary").distinct().join(ok, "source").where("_at < boundary").groupBy("source", "boundary").agg(F.max("_at").alias("_prior"))
    rows = eras.join(prior, ["source", "boundary"], "left")
    need = F.when((F.col("kind") == "observed") & F.col("_prior").isNull(), F.raise_error(F.lit("an observed era has no confirming poll before it")).cast("long")).when(F.col("kind") == "observed", F.col("_prior"))
    out = rows.withColumn("prior_ms", need).drop("_prior").repartitionByRange("provider", "model", "fact_key").sortWithinPartitions("provider", "model", "fact_key").withColumn("id", row_ids(first_id))
    return out.select(*[f.split()[0] for f in ERA.split(", ")])


def append_eras(eras: DataFrame, observations: DataFrame, path: str, now: int, first_id: int) -> str:
    """Writes era_rows() as one batch: all or nothing."""
    return append_batch(era_rows(eras, observations, first_id), path, now)


def seed_if_empty(spark: SparkSession, facts: DataFrame, path: str, source: str, now: int, observations: str | None = None) -> bool:
    """An empty ledger is filled from a snapshot with eras of kind seed (no poll, no window), and the log of polls, if given, with one
    observation `seeded`, which confirms for the eras after it, in the same commit; a second run writes nothing."""
    if not read_or_empty(spark, path, ERA).isEmpty():
        return False
    blank = {f.split()[0]: f.split()[1] for f in ERA.split(", ")}
    given = {"id": row_ids(poll_ids(0)), "source": F.lit(source), "boundary": F.lit(now).cast("long"), "kind": F.lit("seed")}
    cols = [given[c].alias(c) if c in given else F.col(c) if c in facts.columns and c not in ("prior_ms", "observation_id") else F.lit(None).cast(t).alias(c) for c, t in blank.items()]
    ledger, name = _split(path)
    parts = {name: facts.select(*cols)}
    if observations is not None:
        if _split(observations)[0] != ledger:
            raise ValueError("tables of one commit lie in one folder")
        parts[_split(observations)[1]] = spark.createDataFrame([(0, source, now, "seeded", None, None, None, None, None, None)], OBSERVATION)
    return commit(spark, ledger, parts, now)


def import_history(df: DataFrame, schema: str, target_is_empty: bool) -> DataFrame:
    """df, if its columns are the table's and its ids rise in the order given by `pos`; a target that holds rows is refused."""
    want = [f.split()[0] for f in schema.split(", ")]
    if not target_is_empty or sorted(c for c in df.columns if c != "pos") != sorted(want):
        raise ValueError("history goes only into an empty table with the same columns")
    # ids rise with pos exactly when each range slice rises inside and no id repeats across slices: compare ranks by sorting once
    from pyspark.sql import Window

    slices = df.withColumn("_slice", F.floor(F.col("pos") / 1_000_000))
    inside = slices.withColumn("_before", F.lag("id").over(Window.partitionBy("_slice").orderBy("pos")))
    edges = slices.groupBy("_slice").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).withColumn("_last", F.lag("hi").over(Window.partitionBy().orderBy("_slice")))
    bad = inside.where("_before >= id").select("_slice").unionByName(edges.where("_last >= lo").select("_slice")).limit(1)
    if not bad.isEmpty():
        raise ValueError("ids must rise strictly")
    return df.select(*want)


def export_state(eras: DataFrame, at: int, null_ok: tuple[str, ...] = ()) -> DataFrame:
    """Facts in force at an instant of entities that are present, as bare claims without annotations, without tombstones (null values) but for
    keys that may be null."""
    from factledger.functions.claims import canonical
    from factledger.operators.asof import filter_presence

    facts = filter_presence(as_of(eras.select("provider", "model", "fact_key", "value_json", "boundary", "id"), at, ["provider", "model", "fact_key"]), ["provider", "model"])
    return facts.where((F.col("value_json") != "null") | F.col("fact_key").isin(*null_ok)).select("provider", "model", "fact_key", canonical(F.col("value_json")).alias("value_json"))


def export_history(df: DataFrame, path: str) -> int:
    """Rows in the order of their ids as Parquet; a row that holds a path of a home folder stops the export."""
    leak = r"(/home/|/Users/|[A-Z]:\\Users\\)"
    found = df.where(F.to_json(F.struct(*df.columns)).rlike(leak)).limit(1)
    if not found.isEmpty():
        raise ValueError("a row holds a path of a home folder")
    df.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    return df.sparkSession.read.parquet(path).count()


def history_days(ops: DataFrame, path: str, first_release: int = 0, days: int | None = None) -> None:
    """Ops of releases in one folder per UTC day, bounds [start, start + a day). The import (release first_release) is left out. A release that
    is missing between others, and, with days, a day without any up to the last, is refused before anything is written. A day is
    dealt in ranges of (release, position), so a large one is many tasks' work."""
    from pyspark.sql import Window

    rows = ops.where(F.col("release") > first_release).withColumn("day", F.to_date(F.timestamp_millis("published_at_ms")))
    told = rows.select("release", "day").distinct()
    order = Window.partitionBy().orderBy("release")  # one row per release
    if not told.withColumn("_gap", F.col("release") - F.lag("release").over(order)).where("_gap > 1").isEmpty():
        raise ValueError("a release is missing")
    if days is not None and told.select("day").distinct().count() != days:
        raise ValueError("a day is empty")
    rows.repartitionByRange("day", "release", "pos").sortWithinPartitions("day", "release", "pos").write.partitionBy("day").parquet(path)
