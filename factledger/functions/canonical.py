"""Canonical JSON: one spelling for what a value says, so that hashes agree wherever it is written.

Keys are sorted by code point, nothing is blank between tokens, numbers keep their digits (only -0 is 0, and an exponent is e with its
sign), text is escaped only where JSON demands it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class Number(str):
    """A number as it is written."""


def parse(text: str):
    def refuse(word: str):
        raise ValueError(f"{word} is no JSON")

    return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=refuse)


def spell(value) -> str:
    if isinstance(value, Number):
        digits, e, power = value.replace("E", "e").partition("e")
        if e:
            return f"{digits}e{power if power[0] in '+-' else '+' + power}"
        return "0" if digits == "-0" else digits
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{spell(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(spell, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def canonical_text(text: str) -> str:
    return spell(parse(text))


@F.pandas_udf(StringType())
def _canonical(c: pd.Series) -> pd.Series:
    return c.map(canonical_text, na_action="ignore")


def canonical_json(c: Column) -> Column:
    """The canonical spelling of JSON text; null stays null, text that is no JSON stops the job."""
    return _canonical(c)


def value_hash(c: Column) -> Column:
    """SHA-256 of a value's canonical spelling."""
    return F.sha2(canonical_json(c), 256)
