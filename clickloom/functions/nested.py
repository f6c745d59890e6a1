"""X11: the first value stored under any of several keys inside a JSON
document.  An object's own entries come before what is nested in them; nested
values follow in document order.  Only text counts as a result, trimmed, empty
as NULL.

Spark SQL has no recursive JSON path, so this is an Arrow-batched
``pandas_udf``; callers apply it to conversion rows only.  Each distinct
document of a batch is parsed once.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_NONE = object()


def find_nested(doc, keys: frozenset):
    """Walks the document with a stack of what is still to be looked at.  An
    empty text inside the document hides its object; at the top it is the
    result."""
    waiting = [doc]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            held = next((v for k, v in node.items() if k in keys and v is not None), _NONE)
            if held is _NONE:
                waiting += reversed(node.values())
            elif held != "" or node is doc:
                return held
        elif isinstance(node, list):
            waiting += reversed(node)
    return None


def _text(value) -> str | None:
    return (value.strip() or None) if isinstance(value, str) else None


def nested_find_many(doc: Column, searches: dict[str, list[str]]) -> Column:
    """Several nested searches over one document: struct<name: string, ...>
    in the order of ``searches``."""
    wanted = {name: frozenset(keys) for name, keys in searches.items()}
    schema = ", ".join(f"{name} string" for name in wanted)

    def results(text: str) -> list[str | None]:
        try:
            parsed = json.loads(text)
        except ValueError:
            return [None] * len(wanted)
        return [_text(find_nested(parsed, keys)) for keys in wanted.values()]

    @pandas_udf(schema)
    def search(docs: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(docs)
        found = [results(d) for d in distinct] + [[None] * len(wanted)]  # code -1: NULL
        return pd.DataFrame([found[c] for c in codes], columns=list(wanted), dtype=object)

    return search(doc)
