"""Redaction of sensitive fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import rules as R
from .regex import any_word

MAX_TEXT, MAX_DEPTH = 1000, 10


def sensitive_key(k: Column) -> Column:
    return any_word(F.lower(k), R.SENSITIVE_KEYS)


def cut_text(v: Column, max_text: int | None = MAX_TEXT) -> Column:
    if max_text is None:
        return v
    return F.when(F.length(v) > max_text,
                  F.concat(F.substring(v, 1, max_text), F.lit("[TRUNCATED]"))).otherwise(v)


def redact_map(m: Column, max_text: int | None = MAX_TEXT) -> Column:
    """Flat map<string,string>: sensitive keys hidden, values longer than ``max_text`` cut (``None``: none is)."""
    return F.transform_values(m, lambda k, v: F.when(sensitive_key(k), F.lit("[REDACTED]"))
                              .otherwise(cut_text(v, max_text)))


def redact_json(text: Column, max_text: int | None = MAX_TEXT, max_depth: int | None = MAX_DEPTH) -> Column:
    """Nested JSON text; text that is not JSON stays NULL.  ``None`` lifts the limit on text or on depth."""
    def clean(v, depth: int = 0):
        if max_depth is not None and depth > max_depth:
            return "[MAX_DEPTH_EXCEEDED]"
        if isinstance(v, dict):
            return {k: "[REDACTED]" if any(w in k.lower() for w in R.SENSITIVE_KEYS) else clean(x, depth + 1) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x, depth + 1) for x in v]
        if max_text is not None and isinstance(v, str) and len(v) > max_text:
            return v[:max_text] + "[TRUNCATED]"
        return v

    def one(t):
        try:
            return json.dumps(clean(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run(text)
