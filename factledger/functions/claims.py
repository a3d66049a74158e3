"""Claims: JSON values compared by what they say, not by how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: the field that the engine itself adds to a stored value, which is no part of the claim.
ANNOTATION = "unit_provenance"


def canonical(c: Column) -> Column:
    """JSON with sorted keys, no spaces and no annotation; text that is no JSON stays as it is. The order of arrays stays."""
    j = F.to_json(F.try_parse_json(c))
    field = rf'"{ANNOTATION}":(?:\{{[^{{}}]*\}}|"[^"]*"|[^,{{}}"]+),?'
    bare = F.regexp_replace(F.regexp_replace(j, field, ""), r",\}$", "}")
    return F.coalesce(F.when(j.contains(f'"{ANNOTATION}"'), bare).otherwise(j), c)


def same_claim(a: Column, b: Column) -> Column:
    return canonical(a).eqNullSafe(canonical(b))


def sorted_list(c: Column) -> Column:
    return F.array_sort(c)


def lists(c: Column, value: Column) -> Column:
    return F.coalesce(F.exists(c, lambda x: x == value), F.lit(False))


def put(facts: Column, key: Column, value: Column) -> Column:
    """A map with one entry set, whether it was there or not."""
    rest = F.map_filter(facts, lambda k, _: k != key)
    return F.map_concat(F.coalesce(rest, F.create_map().cast("map<string,string>")), F.create_map(key, value))


def has_key(facts: Column, key: Column) -> Column:
    """Whether a map has a key, false where either is null. For use inside lambdas, where Spark interprets expressions: there map_contains_key leaves its loop by
    throwing when it finds the key, exists by a plain condition."""
    return lists(F.map_keys(facts), key)


def bound(f, *columns: Column) -> Column:
    """f of the columns, each computed once for a row: inside a lambda Spark computes an expression again for every element."""
    values = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(columns)])
    return F.transform(F.array(values), lambda x: f(*[x[f"_{i}"] for i in range(len(columns))]))[0]


def merged(facts: Column, new: Column) -> Column:
    """A map with all entries of another set, for columns of the row: what is no column is computed again for every key (put_all)."""
    return F.map_concat(F.map_filter(facts, lambda k, _: ~has_key(new, k)), new)


def put_all(facts: Column, new: Column) -> Column:
    """A map with all entries of another set."""
    return bound(merged, facts, new)


def quoted(c: Column) -> Column:
    """Text as a JSON string; null stays null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def text_of(value: Column) -> Column:
    """The text of a JSON string; null for anything else that has none."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def with_field(value: Column, name: str, said: Column) -> Column:
    """A JSON object with one field more (JSON) unless it has it; other values stay."""
    add = value.rlike(r"^\s*\{") & F.get_json_object(value, f"$.{name}").isNull()
    body = F.regexp_replace(value, r"\}\s*$", "")
    comma = F.when(body.rlike(r"^\s*\{\s*$"), F.lit("")).otherwise(F.lit(","))
    return F.when(add, F.concat(body, comma, F.lit(f'"{name}":'), said, F.lit("}"))).otherwise(value)


#: The shape of an entity's reasoning options: a list of which the entries of type effort name values.
OPTIONS = "array<struct<type string, values array<string>, min bigint, max bigint>>"


def listed_efforts(options: Column) -> Column:
    """All values of the entries of type effort of an entity's reasoning options (JSON); none for null."""
    entries = F.filter(F.from_json(options, OPTIONS), lambda o: (o["type"] == "effort") & o["values"].isNotNull())
    return F.coalesce(F.flatten(F.transform(entries, lambda o: o["values"])), F.array().cast("array<string>"))


def restricted_options(options: Column, wire_ids: Column) -> Column:
    """Option lists with only the effort values that the map has, in their order; entries of another type stay."""
    def kept(o: Column) -> Column:
        return F.when(o["type"] == "effort", o.withField("values", F.filter(o["values"], lambda v: F.map_contains_key(wire_ids, v)))).otherwise(o)
    return F.coalesce(F.to_json(F.transform(F.from_json(options, OPTIONS), kept)), options)
