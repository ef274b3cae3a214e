"""Model replies kept as text in a table: fences off, outermost object, typed parse."""

from __future__ import annotations

import contextlib
import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip_fences(reply: Column) -> Column:
    trimmed = F.trim(F.coalesce(reply, F.lit("")))
    return F.trim(F.regexp_replace(trimmed, r"(?s)^```[a-zA-Z]*\s*|\s*```$", ""))


def reply_object(reply: Column, schema: str) -> Column:
    """The reply as a struct: parsed whole, else from its outermost braces, else null."""
    clean = strip_fences(reply)
    braces = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    whole = F.when(F.schema_of_variant(F.try_parse_json(clean)).startswith("OBJECT"), clean)
    inner = F.when(F.schema_of_variant(F.try_parse_json(braces)).startswith("OBJECT"), braces)
    return F.from_json(F.coalesce(whole, inner), schema)


def confidence(value: Column, default: float = 0.6) -> Column:
    """Number clamped to [0, 1]; anything unreadable takes the default."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def flag(value: Column) -> Column:
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "yes"), F.lit(True)).when(low.isin("false", "no"), F.lit(False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def ids_in_json(values: pd.Series, prefixes: pd.Series) -> pd.Series:
    """Distinct texts under ``id`` keys that start with the prefix, in reading order; a text that is itself JSON is read on."""
    return pd.Series([list(dict.fromkeys(_ids(v, p))) for v, p in zip(values, prefixes, strict=True)], dtype="object")


def _ids(value: str, prefix: str) -> Iterator[str]:
    line: deque = deque([value])
    while line:
        match line.popleft():
            case str() as text if text.lstrip()[:1] in ("{", "["):
                with contextlib.suppress(ValueError):
                    line.appendleft(json.loads(text))
            case list() as items:
                line.extendleft(reversed(items))
            case dict() as fields:
                if isinstance(fields.get("id"), str) and fields["id"].startswith(prefix):
                    yield fields["id"]
                line.extendleft(reversed(fields.values()))
