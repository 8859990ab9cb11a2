"""Canonical JSON and digests of raw rows, hashed from their own text."""

from __future__ import annotations

import hashlib
import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digest recipes, the first link, the length of a link.
JSON_RECIPE, BYTES_RECIPE = "sha256:json-c14n:v1:", "sha256:raw-bytes:v1:"
GENESIS, LINK = "genesis", 32


def parse(raw: str | bytes | None, unique_keys: bool = False) -> tuple[bool, object]:
    """(readable, value); not readable: bad JSON, nesting too deep, or, if asked, a key twice in one object."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a key stands twice")
        return dict(items)

    try:
        return True, json.loads(raw, object_pairs_hook=pairs) if unique_keys else json.loads(raw)
    except (ValueError, RecursionError, TypeError):
        return False, None


def canonical(value: object) -> str:
    """Sorted keys, no spaces, text as it is; NaN and infinities have no canonical form (ValueError)."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: object) -> str:
    return JSON_RECIPE + hashlib.sha256(canonical(value).encode()).hexdigest()


def link(previous: str, row: dict, leave_out: tuple[str, ...] = ("chain",)) -> str:
    """The chain value of a row: of the previous link and the row without its own."""
    body = json.dumps({k: v for k, v in row.items() if k not in leave_out}, sort_keys=True, ensure_ascii=False)
    return hashlib.sha256((previous + body).encode("utf-8", "surrogatepass")).hexdigest()[:LINK]


def _number(x: float) -> str:
    """A double the way ECMAScript prints it: its shortest digits, plain from 1e-6 up to 1e21, else with an exponent."""
    if not math.isfinite(x):
        raise ValueError("no canonical form")
    exact = Decimal(repr(x)).normalize()
    if not exact:
        return "0"
    plain = Decimal("1e-6") <= abs(exact) < Decimal("1e21")
    return format(exact, "f") if plain else format(exact, "e")


def _string(text: str) -> str:
    text.encode("utf-8")  # a lone surrogate has no canonical form: UnicodeEncodeError is a ValueError
    return json.dumps(text, ensure_ascii=False)


_PLAIN = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def _is_plain(value: object) -> bool:
    """Whether the json module's own text is the canonical one: no doubles, no integer beyond 2**53, ASCII keys."""
    kind = type(value)
    if kind is str or kind is bool or value is None:
        return True
    if kind is int:
        return abs(value) <= 2**53
    if kind is dict:
        return all(map(str.isascii, value)) and all(map(_is_plain, value.values()))
    return kind is list and all(map(_is_plain, value))


def jcs(value: object) -> str:
    """RFC 8785 canonical JSON; integers beyond 2**53 are refused (ValueError)."""
    if _is_plain(value):
        text = _PLAIN(value)
        text.encode("utf-8")  # as in _string
        return text
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, int):
        if abs(value) > 2**53:
            raise ValueError("integer beyond 2**53")
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, list):
        return "[" + ",".join(map(jcs, value)) + "]"
    items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(_string(k) + ":" + jcs(v) for k, v in items) + "}"


def _or_null(f, raw: str | None) -> str | None:  # noqa: ANN001
    ok, value = parse(raw)
    try:
        return f(value) if ok else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def digest_json(raw: pd.Series) -> pd.Series:
    """Digest of JSON text; null where it can't be read or has no canonical form."""
    return raw.map(lambda r: _or_null(digest, r))


@F.pandas_udf(T.StringType())
def canon_jcs(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: _or_null(jcs, r))


def digest_bytes(data: Column) -> Column:
    return F.concat(F.lit(BYTES_RECIPE), F.sha2(data, 256))
