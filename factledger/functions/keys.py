"""Fact keys and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_rate_key(c: Column) -> Column:
    """rate.CLASS[.above_context.N][.mode.M][.ttl.T] -> struct(base, above_context long, mode, ttl); null for other keys."""
    part = lambda name, pattern: F.nullif(F.regexp_extract(c, rf"\.{name}\.({pattern})(?:\.|$)", 1), F.lit(""))
    base = F.regexp_extract(c, r"^rate\.([a-z0-9_]+)", 1)
    return F.when(c.startswith("rate.") & (base != ""), F.struct(base.alias("base"), part("above_context", "[0-9]+").cast("long").alias("above_context"), part("mode", "[a-z0-9_-]+").alias("mode"), part("ttl", "[^.]+").alias("ttl")))


def is_rate_relevant(c: Column) -> Column:
    return c.startswith("rate.") | (c == "existence")


def is_mode_name(c: Column) -> Column:
    return c.rlike("^[a-z0-9_-]+$")


def split_id(c: Column) -> Column:
    """lab/model at the first slash; lab is null without one."""
    at = F.instr(c, "/")
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).alias("lab"), F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(c).alias("model"))


def join_id(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("/"), b)


def is_model_key(c: Column) -> Column:
    """No white space or control character, not empty; local: must be followed by a key."""
    return F.coalesce(~c.rlike(r"[\s\p{Cntrl}]") & (c != "") & (c != "local:"), F.lit(False))


def withdrawal_value(key: Column) -> Column:
    """What a fact holds after its source stopped stating it."""
    return F.when(key.startswith("rate."), F.lit('{"reason":"missing_rate","state":"unpriced"}')).otherwise(F.lit("null"))


def has_prefix(key: Column, prefixes: list[str] | None) -> Column:
    """True where key starts with one of prefixes; without prefixes everywhere."""
    if not prefixes:
        return F.lit(True)
    out = F.lit(False)
    for p in prefixes:
        out = out | key.startswith(p)
    return out


def is_mode_rate(key: Column) -> Column:
    return key.startswith("rate.") & key.contains(".mode.")


#: Kinds of fields and what their keys begin with.
FIELDS = {"rate": "rate.", "limit": "limit.", "capability": "capability.", "model": "model.", "wire": "wire."}


def fact_key_for(kind: Column, name: Column, mode: Column) -> Column:
    """The fact key of a field: kind existence, provider_name, or one of FIELDS with a name; a rate with a mode is that of the mode. Null for
    fields that no single key holds: tiers and charge units, and modes whose name can't be part of a key."""
    key = F.when(kind == "existence", "existence").when(kind == "provider_name", "provider.name")
    for k, prefix in FIELDS.items():
        plain = F.concat(F.lit(prefix), name)
        key = key.when(kind == k, F.when(mode.isNull(), plain).when((kind == "rate") & is_mode_name(mode), F.concat(plain, F.lit(".mode."), mode)))
    return key
