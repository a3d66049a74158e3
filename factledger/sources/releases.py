"""Release files: a change of facts on two levels with the envelope that vouches for it, read, checked and written.

A file is {"envelope": {...}, "change": {"curation_set": ..., "upstream": [op, ...]}, ...}. An op is set or remove (provider, model, fact) or
set_provider or remove_provider (provider, fact); a set has a value, any JSON. As rows, facts of the provider itself have a null model and
values are canonical JSON text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factledger.functions.canonical import canonical_json, parse, spell
from factledger.functions.claims import quoted

ENVELOPE = "release LONG, parent LONG, published_at_ms LONG, upstream_observed_at_ms LONG, upstream_hash STRING, curation_version LONG, curation_hash STRING, state_hash STRING, change_hash STRING"
ROW = f"{ENVELOPE}, curation_set STRING, n_ops LONG, pos LONG, op STRING, provider STRING, model STRING, fact_key STRING, value STRING"
_ENVELOPE_NAMES = [f.split()[0] for f in ENVELOPE.split(", ")]
#: The members that each kind of op has.
MEMBERS = {"set": {"op", "provider", "model", "fact", "value"}, "remove": {"op", "provider", "model", "fact"}, "set_provider": {"op", "provider", "fact", "value"}, "remove_provider": {"op", "provider", "fact"}}
_STEP = 5_000


def _rows(name: str, text: str) -> Iterator[dict]:
    """The envelope's row (pos null), then a row for each op; anything that isn't a release is an error that names the file."""
    try:
        d = parse(text)
        head = {k: d["envelope"][k] for k in _ENVELOPE_NAMES}
        head = {k: v if v is None or k.endswith("hash") else int(v) for k, v in head.items()}
        ops, curation = d["change"]["upstream"], d["change"]["curation_set"]
        if not isinstance(ops, list):
            raise ValueError("upstream is no list")
        yield head | {"curation_set": None if curation is None else spell(curation), "n_ops": len(ops)}
        for pos, o in enumerate(ops):
            if MEMBERS.get(o.get("op")) != set(o):
                raise ValueError(f"op {pos} isn't one of {', '.join(MEMBERS)} with its members")
            if not all(type(o[k]) is str for k in ("provider", "fact")) or type(o.get("model", "")) is not str:
                raise ValueError(f"a name of op {pos} is no text")
            row = {"release": head["release"], "parent": head["parent"], "published_at_ms": head["published_at_ms"], "pos": pos, "op": o["op"], "provider": o["provider"], "model": o.get("model"), "fact_key": o["fact"]}
            yield row | ({"value": spell(o["value"])} if "value" in o else {})
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError) as e:
        raise ValueError(f"{name} is no release: {e!r}") from e


def parse_releases(raw: DataFrame) -> DataFrame:
    """raw(file, value) -> rows of envelopes (pos null) and of ops, see ROW. A file that isn't a release stops the job. A file is the unit that a
    publisher writes, so a task holds one at a time."""
    schema = StructType.fromDDL(ROW)
    names = schema.fieldNames()
    types = pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.string()) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in _rows(name, text.as_py() or ""):
                    out.append(row)
                    if len(out) == _STEP:
                        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], types)
                        out.clear()
        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], types)

    return raw.select("file", "value").mapInArrow(run, schema)


def envelopes(rows: DataFrame) -> DataFrame:
    return rows.where("pos IS NULL").select(*_ENVELOPE_NAMES, "curation_set", "n_ops")


def ops(rows: DataFrame) -> DataFrame:
    return rows.where("pos IS NOT NULL").select("release", "parent", "published_at_ms", "pos", "op", "provider", "model", "fact_key", "value")


def read_release_files(spark: SparkSession, path: str) -> DataFrame:
    """See parse_releases; write the rows out where both envelopes and ops are used, or the files are parsed twice."""
    return parse_releases(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def op_text(op: Column, provider: Column, model: Column, fact: Column, value: Column) -> Column:
    """The canonical JSON of an op. `op` may be set or remove for both levels: a null model makes it the provider's."""
    kind = F.when(op.endswith("_provider") | model.isNotNull(), op).otherwise(F.concat(op, F.lit("_provider")))
    parts = [
        F.lit('{"fact":'), quoted(fact), F.when(model.isNotNull(), F.concat(F.lit(',"model":'), quoted(model))).otherwise(""),
        F.lit(',"op":"'), kind, F.lit('","provider":'), quoted(provider),
        F.when(op.startswith("set"), F.concat(F.lit(',"value":'), F.coalesce(value, F.lit("null")))).otherwise(""), F.lit("}"),
    ]
    return canonical_json(F.concat(*parts))


def _op_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_op", op_text(F.col("op"), F.col("provider"), F.col("model"), F.col("fact_key"), F.col("value")))


def change_hashes(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """(release, change_hash) of heads(release, curation_set, n_ops) and their ops: SHA-256 of the canonical change, streamed op by op in the order
    of pos. The format makes a release one chain of bytes, so one task hashes it, holding an op at a time."""
    from factledger.operators.diff import running_digest

    first = heads.select("release", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit('{"curation_set":'), F.coalesce(canonical_json(F.col("curation_set")), F.lit("null")), F.lit(',"upstream":[')).alias("_part"))
    last = heads.select("release", F.lit(2**62).cast("long").alias("pos"), F.lit("]}").alias("_part"))
    one = _op_rows(rows).select("release", F.col("pos").cast("long").alias("pos"), F.concat(F.when(F.col("pos") > 0, ",").otherwise(""), "_op").alias("_part"))
    parts = first.unionByName(one).unionByName(last)
    return running_digest(parts, ["release"], "_part", order="pos").withColumnRenamed("digest", "change_hash")


def write_releases(heads: DataFrame, rows: DataFrame, path: str, signatures: Column | None = None) -> None:
    """One file per release, in folders release=N: a line for each op, so no row or task holds a change. heads has the columns of
    envelopes(); rows those of ops(), pos from 0 without gaps."""
    fields = [F.concat(F.lit(f'"{n}":'), F.coalesce(quoted(F.col(n)) if n.endswith("hash") else F.col(n).cast("string"), F.lit("null"))) for n in sorted(_ENVELOPE_NAMES)]
    signed = F.lit("") if signatures is None else F.concat(F.lit(',"signatures":'), signatures)
    first = heads.select("release", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit('{"change":{"curation_set":'), F.coalesce("curation_set", F.lit("null")), F.lit(',"upstream":[')).alias("value"))
    last = heads.select("release", F.lit(2**62).cast("long").alias("pos"), F.concat(F.lit(']},"envelope":{'), F.concat_ws(",", *fields), F.lit("}"), signed, F.lit("}")).alias("value"))
    one = _op_rows(rows).select("release", F.col("pos").cast("long").alias("pos"), F.concat(F.when(F.col("pos") > 0, ",").otherwise(""), "_op").alias("value"))
    lines = first.unionByName(one).unionByName(last).repartition("release").sortWithinPartitions("release", "pos")
    lines.select("release", "value").write.partitionBy("release").text(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot file {"envelope": ..., "state": {"upstream": {provider: {"provider": {fact: value}, "models": {model: {fact: value}}}}}} as facts
    (provider, model, fact_key, value_json), null model for the provider's own; one file at a time to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(n, pa.string()) for n in ("provider", "model", "fact_key", "value_json")])
        out: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 4)], schema=types)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    for provider, p in parse(text.as_py() or "")["state"]["upstream"].items():
                        for model, facts in [(None, p["provider"]), *p["models"].items()]:
                            out += [(provider, model, fact, spell(v)) for fact, v in facts.items()]
                        if len(out) >= _STEP:
                            yield flush()
                            out.clear()
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    raise ValueError(f"{name} is no snapshot: {e!r}") from e
        yield flush()

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return raw.mapInArrow(run, "provider string, model string, fact_key string, value_json string")


def check_envelopes(heads: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(release, violation) of what an envelope says by itself: parent (release 1 has none, others the one before), state_hash (of its two halves)
    and, with hashes(release, change_hash), change_hash."""
    from factledger.operators.diff import state_hash

    h = heads
    change = F.lit(None).cast("string")
    if hashes is not None:
        h = h.join(hashes.select("release", F.col("change_hash").alias("_hash")), "release", "left")
        change = F.when(~F.col("change_hash").eqNullSafe(F.col("_hash")), "change_hash")
    parent = F.when(F.col("release") == 1, F.col("parent").isNull()).otherwise(F.col("parent").eqNullSafe(F.col("release") - 1))
    found = F.array_compact(F.array(
        F.when(~parent | (F.col("release") < 1), "parent"),
        F.when(~F.col("state_hash").eqNullSafe(state_hash(F.col("curation_hash"), F.col("upstream_hash"))), "state_hash"), change,
    ))
    return h.select("release", F.explode(found).alias("violation"))
