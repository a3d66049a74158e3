"""Snapshot differences and deltas: what changed between two states of keyed facts, and replaying it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factledger.functions.claims import same_claim
from factledger.functions.keys import withdrawal_value


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys are equal, as those of a provider's own facts are; the keys stand once, first. `how`: inner, left, full_outer,
    left_semi or left_anti."""
    other = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    met = a.join(other, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how)
    if how in ("left_semi", "left_anti"):
        return met
    rest = [c for c in [*a.columns, *b.columns] if c not in keys]
    if how != "full_outer":
        return met.select(*keys, *rest)
    there = F.col("_left_side").isNotNull()  # a null on one side may be the key itself
    met = a.withColumn("_left_side", F.lit(True)).join(other, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how)
    return met.select(*[F.when(there, F.col(k)).otherwise(F.col(f"_r_{k}")).alias(k) for k in keys], *rest)


def diff_keyed(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs, with old_value, new_value and change: added, removed or changed. One full outer join, null keys equal."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return join_on(a, b, keys, "full_outer").withColumn("change", change).where("change IS NOT NULL").drop("_a", "_b")


def plan_ingest(current: DataFrame, incoming: DataFrame, entity: list[str], touched: DataFrame | None = None) -> DataFrame:
    """The eras to append so that facts in force become the incoming ones: (entity, fact_key, value_json, change).

    Entities that are not present now (unknown, or said to be absent) are `new`: their existence, and every fact that differs from
    what is still held of them. Of those present, changed facts are `changed`. A held fact that is no longer stated is
    `withdrawn` (once). A present entity that is gone `disappeared`: only existence = "absent". With `touched`, other entities
    are left alone. Facts of `existence` are in both tables like any other.
    """
    if touched is not None:
        current, incoming = (d.join(touched.select(*entity).distinct(), entity, "left_semi") for d in (current, incoming))
    keys = [*entity, "fact_key"]
    existence = F.col("fact_key") == "existence"
    a = current.select(*keys, F.col("value_json").alias("old"), F.lit(True).alias("_old"))
    b = incoming.select(*keys, F.col("value_json").alias("new"), F.lit(True).alias("_new"))
    both = a.join(b, keys, "full_outer")
    # one row per entity: whether it is present now, and whether it is stated
    state = both.groupBy(*entity).agg(F.max(existence & (F.col("old") == '"present"')).alias("_present"), F.max(F.col("_new")).alias("_there"))
    both = both.join(state, entity).withColumn("_present", F.coalesce("_present", F.lit(False)))
    gone, fresh = F.col("_there").isNull(), F.when(F.col("_present"), "changed").otherwise("new")
    value = F.when(gone, F.lit('"absent"')).when(F.col("_new"), F.col("new")).otherwise(withdrawal_value(F.col("fact_key")))
    change = (
        F.when(gone, F.when(existence & F.col("_present"), "disappeared"))
        .when(F.col("_new") & existence, F.when(~F.col("_present"), "new"))
        .when(F.col("_new") & (F.col("_old").isNull() | ~same_claim(F.col("old"), F.col("new"))), fresh)
        .when(F.col("_new").isNull() & ~existence & ~same_claim(F.col("old"), withdrawal_value(F.col("fact_key"))), "withdrawn")
    )
    return both.select(*keys, value.alias("value_json"), change.alias("change")).where("change IS NOT NULL")


def ingest_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def split_conflicts(facts: DataFrame, keys: list[str], value: str = "value_json") -> tuple[DataFrame, DataFrame]:
    """(facts stated one way, with repeats collapsed; keys stated in several ways, with the sorted values)."""
    by = facts.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return by.where("size(values) = 1").select(*keys, F.col("values")[0].alias(value)), by.where("size(values) > 1")


def publish_delta(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value_json") -> DataFrame:
    """Ops that turn old into new: (keys, op set | remove, value); null keys are equal. Compares digests, so a wide old side can be kept as hashes."""
    a = old.select(*keys, F.sha2(F.col(value), 256).alias("_a"))
    b = new.select(*keys, F.col(value).alias("value"), F.sha2(F.col(value), 256).alias("_b"))
    met = join_on(a, b, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return met.select(*keys, F.when(F.col("_b").isNull(), "remove").otherwise("set").alias("op"), "value")


SETS, REMOVES = ("set", "set_provider"), ("remove", "remove_provider")


def rising(ops: DataFrame, by: list[str], pos: str, rank: list[str], width: int = 1 << 16) -> DataFrame:
    """Ops whose rank doesn't exceed that of the op before them (of the same `by`, in the order of pos; a null ranks first). Ops are dealt in
    slices of `width` positions and compared inside; then the last of a slice is compared with the first of the next one, over one row
    for each slice. So an order of any length is many tasks' work."""
    slice_, key = F.floor(F.col(pos) / width).alias("_slice"), F.struct(*[F.struct(F.col(k).isNotNull().alias("there"), F.col(k).alias("v")).alias(k) for k in rank]).alias("_key")
    keep = list(dict.fromkeys([*by, *rank]))
    o = ops.select(*keep, F.col(pos).alias("_pos"), slice_, key)
    inside = Window.partitionBy(*by, "_slice").orderBy("_pos")
    bad = o.withColumn("_before", F.lag("_key").over(inside)).where(F.col("_before") >= F.col("_key"))
    edges = o.groupBy(*by, "_slice").agg(F.min_by(F.struct(*keep, "_key"), "_pos").alias("_first"), F.max_by("_key", "_pos").alias("_last"))
    edges = edges.withColumn("_before", F.lag("_last").over(Window.partitionBy(*by).orderBy("_slice"))).where(F.col("_before") >= F.col("_first._key"))
    return bad.select(*keep).unionByName(edges.select(*[F.col("_first")[k].alias(k) for k in keep]))


def replay_change(facts: DataFrame, ops: DataFrame, keys: list[str], value: str = "value_json", order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts after one change, violations), null keys being equal. An op sets or removes (set_provider and remove_provider are the same on a null
    model; any other is unknown_op); a key may occur once in a change (repeated_key), and a removal must hit (removes_nothing). With `order`
    (columns of which the last numbers the ops and those before it separate changes), keys must rise strictly (not_sorted).

    Where keys are (provider, model, ...), rows without a model are facts of the provider itself: one may be set only where the provider
    has facts or the change gives it a model (unknown_provider), and a provider must not be left with these alone
    (orphan_provider_facts). Who gets violations takes none of the change: the facts after it are what its ops would make of them.
    """
    sets, removes = F.col("o.op").isin(*SETS), F.col("o.op").isin(*REMOVES)
    last = ops.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("op", "value"), F.col("op")).alias("o"))
    named = lambda rows, text: rows.select(*keys, F.lit(text).alias("violation"))
    met = join_on(last, facts.select(*keys, F.lit(True).alias("_there")), keys, "left")
    found = F.array_compact(F.array(F.when(F.col("n") > 1, "repeated_key"), F.when(removes & F.col("_there").isNull(), "removes_nothing"), F.when(~(sets | removes), "unknown_op")))
    bad = met.select(*keys, F.explode(found).alias("violation"))
    after = join_on(facts.select(*keys, value), last.where(sets | removes).select(*keys), keys, "left_anti")
    after = after.unionByName(last.where(sets).select(*keys, F.col("o.value").alias(value)))
    if order:
        bad = bad.unionByName(named(rising(ops, order[:-1], order[-1], keys), "not_sorted"))
    if keys[:2] == ["provider", "model"]:
        had = facts.select("provider").distinct().withColumn("_had", F.lit(True))
        gives = last.where(F.col("model").isNotNull() & sets).select("provider").distinct().withColumn("_gives", F.lit(True))
        own = join_on(join_on(last.where(F.col("model").isNull() & sets), had, ["provider"], "left"), gives, ["provider"], "left")
        bad = bad.unionByName(named(own.where("_had IS NULL AND _gives IS NULL"), "unknown_provider"))
        alone = after.groupBy("provider").agg(F.max("model").alias("_m")).where("_m IS NULL").select("provider")
        bad = bad.unionByName(join_on(alone, ops.select("provider").distinct(), ["provider"], "left_semi").select("provider", *[F.lit(None).cast(facts.schema[k].dataType).alias(k) for k in keys[1:]], F.lit("orphan_provider_facts").alias("violation")))
    return after, bad


def replay_chain(base: DataFrame | None, ops: DataFrame, keys: list[str], order: list[str], value: str = "value_json") -> DataFrame:
    """Net state after many changes: per key (null keys equal) the last op wins and removals drop; one aggregation, whatever their number.
    An op that neither sets nor removes stops the job."""
    known = F.when(F.col("op").isin(*SETS, *REMOVES), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    last = ops.withColumn("op", known).groupBy(*keys).agg(F.max_by(F.struct("op", "value"), F.struct(*order)).alias("o"))
    out = last.where(F.col("o.op").isin(*SETS)).select(*keys, F.col("o.value").alias(value))
    return out if base is None else join_on(base.select(*keys, value), last.select(*keys), keys, "left_anti").unionByName(out)


def running_digest(rows: DataFrame, by: list[str], part: str, order: str | None = None) -> DataFrame:
    """(by, digest): SHA-256 of the group's parts, one after another, in the order of `order` or of themselves. Groups are sorted on disk where they are large and
    streamed through one running hash, so no row or task holds a group. Null parts are passed over."""
    schema = StructType([rows.schema[c] for c in by] + [StructField("digest", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, types, sha = None, None, None, None

        def closed(found: list) -> pa.RecordBatch:
            columns = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.string()])], names=[*by, "digest"])

        for batch in batches:
            types, found = [batch.schema.field(c).type for c in by], []
            *keys, parts = [batch.column(i).to_pylist() for i in range(len(by) + 1)]
            for *key, x in zip(*keys, parts):
                same = [None if v is None else ("nan",) if v != v else v for v in key]
                if sha is None or same != now:
                    if sha is not None:
                        found.append((*group, sha.hexdigest()))
                    now, group, sha = same, key, hashlib.sha256()
                if x is not None:
                    sha.update(x.encode())
            if found:
                yield closed(found)
        if sha is not None:
            yield closed([(*group, sha.hexdigest())])

    dealt = rows.select(*by, part, *[order] * bool(order)).repartition(*by).sortWithinPartitions(*by, order or part)
    return dealt.select(*by, part).mapInArrow(run, schema)


def facts_digest(facts: DataFrame, entity: list[str], key: str = "fact_key", value: str = "value_json") -> DataFrame:
    """A digest per entity that does not depend on the order of rows and moves exactly when a fact does: lengths keep the
    borders of key and value apart."""
    row = F.concat(F.length(key).cast("string"), F.lit(":"), F.col(key), F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), F.col(value)), F.lit("-")))
    return running_digest(facts.select(*entity, F.sha2(row, 256).alias("_row")), entity, "_row")


def state_digest(entities: DataFrame, entity: list[str], fan: int = 1024) -> DataFrame:
    """One digest of all entities' digests, in two levels: `fan` slices by hash of the entity, then the slices."""
    rows = entities.select(F.pmod(F.xxhash64(*entity), F.lit(fan)).alias("slice"), F.sha2(F.to_json(F.struct(*entity, "digest")), 256).alias("_row"))
    slices = running_digest(rows, ["slice"], "_row")
    return slices.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "slice", "digest"))), ""), 256).alias("digest"))


def set_digest(facts: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, facts, digest): a digest of a set of rows that does not depend on their order and adds up, so a task sends one number for
    each group whatever the group's size: the sum of 60 bits of each row's SHA-256, with the number of rows. It finds changes; it is no
    proof against somebody who picks rows to cancel each other out."""
    bits = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return facts.groupBy(*by).agg(F.count(F.lit(1)).alias("facts"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest"))


def publish_step(held: DataFrame, incoming: DataFrame, entity: list[str], key: str = "fact_key", value: str = "value_json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ops, conflicts, guard) of a publication. Facts that the document states in several ways are conflicts and left out; ops turn what is held
    into the rest, in the order of their keys, and there are none where the guard (see shrink_guard, over entities; it is asked at once)
    refuses."""
    keys = [*entity, key]
    facts, conflicts = split_conflicts(incoming.select(*keys, value), keys, value)
    guard = shrink_guard(held.select(*entity).distinct(), facts.select(*entity).distinct())
    ops = publish_delta(held, facts, keys, value)
    return (ops.limit(0) if guard.first()["refused"] else ops.orderBy(*keys)), conflicts, guard


def state_hash(curation_hash: Column, upstream_hash: Column) -> Column:
    """The hash of a state from those of its two halves."""
    return F.sha2(F.to_json(F.struct(curation_hash.alias("curation"), upstream_hash.alias("upstream"))), 256)


def change_digests(ops: DataFrame, by: str = "release", pos: str = "pos") -> DataFrame:
    """(by, digest, sorted): SHA-256 of the ops of each change in order, and whether their keys rise strictly. Streamed; no change is gathered."""
    key = F.to_json(F.struct("provider", F.coalesce("model", F.lit("")).alias("model"), "fact_key"), {"ignoreNullFields": "false"})
    row = F.concat(F.lpad(F.col(pos).cast("string"), 19, "0"), F.lit(":"), F.sha2(F.concat_ws("|", "op", key, F.coalesce("value", F.lit("-"))), 256))
    bad = rising(ops, [by], pos, ["provider", "model", "fact_key"]).select(by).distinct().withColumn("_bad", F.lit(True))
    return running_digest(ops.select(by, row.alias("_row")), [by], "_row").join(bad, by, "left").select(by, "digest", F.col("_bad").isNull().alias("sorted"))


def verify_chain(releases: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """releases(release, parent, published_at_ms, n_ops) -> (release, violation): gap, parent, time, empty; curation_version where it is
    there and does not advance by the change of curation (column curation_changed), state_hash where the hash of the state isn't that
    of its two halves (columns state_hash, curation_hash, upstream_hash); and with digests (release, digest, sorted; see change_digests)
    change_hash and not_sorted. One row per release, so the window over all of them is bounded by releases, not by facts."""
    order = Window.partitionBy().orderBy("release")
    r = releases.withColumn("_release", F.lag("release").over(order)).withColumn("_at", F.lag("published_at_ms").over(order))
    follows, never = F.col("_release").isNotNull(), F.lit(None).cast("string")
    changed = F.coalesce("curation_changed", F.lit(False)) if "curation_changed" in r.columns else F.lit(False)
    version = hashes = change = sorted_ = never
    if "curation_version" in r.columns:
        r = r.withColumn("_version", F.lag("curation_version").over(order))
        version = F.when(follows & F.when(changed, F.col("curation_version") <= F.col("_version")).otherwise(F.col("curation_version") != F.col("_version")), "curation_version")
    if "state_hash" in r.columns:
        hashes = F.when(~F.col("state_hash").eqNullSafe(state_hash(F.col("curation_hash"), F.col("upstream_hash"))), "state_hash")
    if digests is not None:
        r = r.join(digests.select("release", F.col("digest").alias("_digest"), F.col("sorted").alias("_sorted")), "release", "left")
        change = F.when((F.coalesce("n_ops", F.lit(0)) > 0) & ~F.col("change_hash").eqNullSafe(F.col("_digest")), "change_hash")
        sorted_ = F.when(~F.coalesce("_sorted", F.lit(True)), "not_sorted")
    reasons = F.array_compact(F.array(
        F.when(follows & (F.col("release") != F.col("_release") + 1), "gap"),
        F.when(follows & ~F.col("parent").eqNullSafe(F.col("_release")), "parent"),
        F.when(F.col("published_at_ms") <= F.col("_at"), "time"),
        F.when((F.coalesce("n_ops", F.lit(0)) == 0) & ~changed, "empty"),
        version, hashes, change, sorted_,
    ))
    return r.select("release", F.explode(reasons).alias("violation"))


def shrink_guard(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: held, incoming, refused. Refused when at least 100 are held and more than a quarter would go; growth never."""
    sides = held.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(incoming.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = sides.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("held"), F.coalesce(F.sum("b"), F.lit(0)).alias("incoming"))
    return counts.withColumn("refused", (F.col("held") >= 100) & ((F.col("held") - F.col("incoming")) * 4 > F.col("held")))
