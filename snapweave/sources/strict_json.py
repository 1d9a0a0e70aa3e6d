"""One strict JSON value, and its canonical form.

Accepted: UTF-8 without a byte order mark, one value, no repeated keys, integers within 2**53 - 1 in
size and not written -0, at most 512 levels. Canonical: keys by UTF-16 units, no spaces, one spelling
of every string.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

MAX_SAFE, MAX_DEPTH = 2**53 - 1, 512


class Refused(ValueError):
    """Why a document is not strict."""


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Refused("duplicate-key")
    return out


def _integer(digits: str) -> int:
    value = int(digits)
    if digits == "-0":
        raise Refused("number")
    if abs(value) > MAX_SAFE:
        raise Refused("range")
    return value


def _number(_: str) -> None:
    raise Refused("number")


def _depth(value: object) -> int:
    level, todo = 0, [value]
    while todo:
        level += 1
        todo = [x for v in todo if isinstance(v, (list, dict)) for x in (v if isinstance(v, list) else v.values())]
    return level


def parse(text: str) -> object:
    """The value; Refused says what is wrong."""
    if text.startswith("﻿"):
        raise Refused("byte-order-mark")
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_int=_integer, parse_float=_number, parse_constant=_number)
    except Refused:
        raise
    except RecursionError:
        raise Refused("depth") from None
    except ValueError:
        raise Refused("syntax") from None
    if _depth(value) > MAX_DEPTH:
        raise Refused("depth")
    return value


def dumps(value: object) -> str:
    """The canonical form of a parsed value."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{dumps(k)}:{dumps(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def canonical(text: Column) -> Column:
    """The canonical form of a JSON column; null where it is refused."""

    @F.pandas_udf(t.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else dumps(parse(x))
            except Refused:
                return None

        return s.map(one)

    return run(text)


def error(text: Column) -> Column:
    """Why a JSON column is refused; null where it is accepted."""

    @F.pandas_udf(t.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                parse(x or "")
                return None
            except Refused as e:
                return str(e)

        return s.map(one)

    return run(text)
