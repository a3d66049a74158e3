"""Exact money: integer units times a power of ten, never doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_minor_units(text: Column, exponent: int = 9) -> Column:
    """Decimal text (exponents allowed) -> struct(units long, error string), rounded half to even.

    Refused, with units null: what is no number, what is negative, and what is not zero but rounds to zero (looked for in
    the text too, since a value under 1e-18 is zero as a decimal).
    """
    value = F.expr("1") if text is None else text.try_cast("decimal(38,18)")
    units = F.bround(value * F.lit(10**exponent).cast("decimal(10,0)"), 0).try_cast("long")
    nonzero = F.regexp_extract(text, r"^[^eE]*", 0).rlike("[1-9]")
    error = (
        F.when(text.isNull() | value.isNull(), "not_a_number")
        .when(value < 0, "negative")
        .when(nonzero & (units == 0), "rounds_to_zero")
        .when(units.isNull(), "out_of_range")
    )
    return F.struct(F.when(error.isNull(), units).alias("units"), error.alias("error"))


def to_nano(units: Column, exponent: Column) -> Column:
    """Units at exponent 0 to 9 as nano units; null above 9 or where negative."""
    factor = F.element_at(F.array(*[F.lit(10 ** (9 - e)).cast("long") for e in range(10)]), (exponent + 1).cast("int"))
    return F.when((exponent >= 0) & (exponent <= 9) & (units >= 0), units * factor)


def exact_ratio(x: Column, n: Column, d: Column) -> Column:
    """x * n / d where that is whole, else null."""
    product = x.cast("decimal(20,0)") * n.cast("decimal(10,0)")
    return F.when((d != 0) & (product % d == 0), (product / d).cast("long"))


def currency_code(c: Column) -> Column:
    code = F.upper(F.trim(c))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def encode_rate(units: Column, exponent: int = 9, currency: str = "USD", reason: str = "missing_rate") -> Column:
    """JSON of a rate that is priced, a stated zero, or unpriced with a reason."""
    priced = F.to_json(F.struct(F.lit("priced").alias("state"), units.alias("units"), F.lit(exponent).alias("exponent"), F.lit(currency).alias("currency")))
    return F.when(units.isNull(), F.to_json(F.struct(F.lit("unpriced").alias("state"), F.lit(reason).alias("reason")))).when(units == 0, F.lit('{"state":"stated_zero"}')).otherwise(priced)


def nano_amount(value: Column) -> Column:
    """Nano units of a rate (JSON) that is priced on its own account: null for other states, for inherited prices and beyond nine places."""
    own = (F.get_json_object(value, "$.state") == "priced") & F.get_json_object(value, "$.inherited_from").isNull()
    return F.when(own, to_nano(F.get_json_object(value, "$.units").try_cast("long"), F.get_json_object(value, "$.exponent").try_cast("int")))
