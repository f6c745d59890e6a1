"""Sanitiser (X7-X9): hash sensitive values, reduce URLs, turn numeric strings
into numbers.

Top-level columns are handled by native expressions chosen per column *name*
(``sanitize_frame``); nested JSON documents (the property bag) need a
walk in depth and go through one Arrow-batched ``pandas_udf``
(``sanitize_json``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from clickloom.config import (
    NON_NUMERIC_KEY_PATTERN,
    SENSITIVE_KEYS,
    URL_CLICK_ID_PARAMS,
    URL_KEY_PATTERN,
    URL_PRESERVED_PARAMS,
)
from clickloom.functions.urls import sanitize_url, sha24

_SENSITIVE = frozenset(SENSITIVE_KEYS)
_NUMERIC = re.compile(r"^[-+]?\d+(?:\.\d+)?$")
_NON_NUMERIC_KEY = re.compile(NON_NUMERIC_KEY_PATTERN[4:], re.IGNORECASE)  # strip the (?i) flag
_URL_KEY = re.compile(URL_KEY_PATTERN[4:], re.IGNORECASE)
#: Texts up to this length are remembered with what their key's rule makes of them, so many at most.
SHORT, REMEMBERED = 32, 50_000
_HTTP = re.compile(r"^https?://", re.IGNORECASE)


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:24]


def number_or_text(text: str):
    """A number for texts that a double holds exactly as written."""
    if not _NUMERIC.match(text) or len(text) >= 18:
        return text
    return float(text) if "." in text else int(text)


def reduced_url(text: str) -> str:
    """What ``urls.sanitize_url`` makes of a URL, for values inside JSON."""
    if not _HTTP.search(text):
        return text
    try:
        url = urlsplit(text)
        host, port = (url.hostname or "").lower(), url.port
    except ValueError:
        return text
    if not host:
        return text
    scheme = url.scheme.lower()
    authority = host if port in (None, 0, {"http": 80, "https": 443}[scheme]) else f"{host}:{port}"
    private = next((p for p in ("/checkouts/", "/cart/") if url.path.startswith(p)), None)
    path = f"{private}hash-{hashed(url.path)}" if private else url.path or "/"
    pairs = parse_qsl(url.query, keep_blank_values=True)
    query = {(f"{k}_hash" if k in URL_CLICK_ID_PARAMS else k): (hashed(v) if k in URL_CLICK_ID_PARAMS else v)
             for k, v in pairs if k in URL_CLICK_ID_PARAMS or k in URL_PRESERVED_PARAMS}
    return f"{scheme}://{authority}{path}" + (f"?{urlencode(query)}" if query else "")


@lru_cache(maxsize=10_000)
def text_rule(key: str) -> Callable[[str], object]:
    """The rule for texts stored under a key."""
    if key.lower() in _SENSITIVE:
        return lambda text: f"sha256:{hashed(text)}" if text else text
    numeric = str if _NON_NUMERIC_KEY.search(key) else number_or_text
    if not _URL_KEY.search(key):
        return numeric
    return lambda text: reduced_url(text) if _HTTP.search(text) else numeric(text)


def by_key(key: str, value):
    """A value stored under ``key``; objects inside are done already, as the
    parser hands them over from the inside out."""
    if isinstance(value, str):
        return text_rule(key)(value)
    return [by_key(key, v) for v in value] if isinstance(value, list) else value


def object_rules() -> Callable[[list[tuple[str, object]]], dict[str, object]]:
    """An object's members by their rules; most are short texts that were seen before."""
    seen: dict[tuple[str, object], object] = {}

    def done(pairs: list[tuple[str, object]]) -> dict[str, object]:
        out = {}
        for pair in pairs:
            key, value = pair
            if type(value) is not str:
                out[key] = by_key(key, value)
            elif pair in seen:
                out[key] = seen[pair]
            else:
                out[key] = text_rule(key)(value)
                if len(value) <= SHORT:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[pair] = out[key]
        return out

    return done


@lru_cache(maxsize=1)
def json_tools() -> tuple[Callable[[str], object], Callable[[object], str]]:
    """Parser and writer of a worker, made once and not for every document."""
    return json.JSONDecoder(object_pairs_hook=object_rules()).decode, json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def cut_depth(value, left: int):
    """Opt-in: replaces what lies deeper than ``left`` levels by a marker."""
    if left < 0:
        return "[depth-limited]"
    if isinstance(value, dict):
        return {k: cut_depth(v, left - 1) for k, v in value.items()}
    return [cut_depth(v, left - 1) for v in value] if isinstance(value, list) else value


def sanitize_json_text(doc: str | None, key: str = "", max_depth: int | None = None) -> str | None:
    """Sanitised text of a JSON document that is stored under ``key``."""
    if doc is None:
        return None
    parse, write = json_tools()
    try:
        parsed = parse(doc)
    except ValueError:
        return str(by_key(key, doc))
    parsed = by_key(key, parsed)
    return write(parsed if max_depth is None else cut_depth(parsed, max_depth))


def sanitize_json(doc: Column, key: str = "properties") -> Column:
    """Column expression: sanitised JSON text of a nested document; each
    distinct document of a batch is done once."""

    @pandas_udf("string")
    def clean(docs: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(docs)
        done = [sanitize_json_text(d, key) for d in distinct] + [None]  # code -1: NULL
        return pd.Series([done[c] for c in codes], dtype=object)

    return clean(doc)


def sanitize_column(name: str, c: Column, dtype: T.DataType) -> Column:
    """Native rule for one top-level column chosen by its name."""
    if not isinstance(dtype, T.StringType):
        return c
    if name.lower() in _SENSITIVE:
        return F.when(c.isNotNull() & (c != ""), F.concat(F.lit("sha256:"), sha24(c))).otherwise(c)
    if _URL_KEY.search(name):
        return F.when(c.rlike(r"(?i)^https?://"), sanitize_url(c)).otherwise(c)
    return c


def sanitize_frame(df: DataFrame, json_columns=("properties",)) -> DataFrame:
    """X-S: sanitise every column of a frame (top-level rules natively, the
    listed JSON columns in depth)."""
    return df.select(*[
        (sanitize_json(F.col(f.name), f.name) if f.name in json_columns else sanitize_column(f.name, F.col(f.name), f.dataType)).alias(f.name)
        for f in df.schema.fields
    ])
