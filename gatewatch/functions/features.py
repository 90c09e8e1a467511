"""Model features of one request, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from urllib.parse import unquote

from .. import rules as R
from .regex import any_word, count_chars, count_text, java_quote

BASIC = ["url_length", "url_params_count", "url_special_chars", "url_encoded_chars", "url_dots",
         "url_slashes", "url_question_marks", "body_length", "body_special_chars",
         "body_encoded_chars", "method_get", "method_post", "method_put", "method_delete",
         "method_other", "ua_length", "ua_is_bot", "ua_is_empty", "hour", "day_of_week",
         "is_weekend", "is_night", "response_status", "response_size", "response_time"]


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def basic_features(url: Column, body: Column, method: Column, ua: Column, ts: Column,
                   status: Column, size: Column, seconds: Column) -> dict[str, Column]:
    """25 numbers from url, body, method, agent, time and response."""
    url, body, ua = (F.coalesce(c, F.lit("")) for c in (url, body, ua))
    verbs = ["GET", "POST", "PUT", "DELETE"]
    hour, day = F.hour(ts), F.weekday(ts)
    cols = [F.length(url), count_chars(url, "&"), count_chars(url, R.FEATURE_SPECIALS),
            count_chars(url, "%"), count_chars(url, "."), count_chars(url, "/"),
            count_chars(url, "?"), F.length(body), count_chars(body, R.FEATURE_SPECIALS),
            count_chars(body, "%"), *[_flag(method == v) for v in verbs],
            _flag(~method.isin(verbs)), F.length(ua),
            _flag(any_word(F.lower(ua), R.FEATURE_BOT_WORDS)), _flag(ua == ""), hour, day,
            _flag(day >= 5), _flag((hour < 6) | (hour > 22)),
            F.coalesce(status, F.lit(200)), F.coalesce(size, F.lit(0)),
            F.coalesce(seconds, F.lit(0.0))]
    return {n: c.cast("double") for n, c in zip(BASIC, cols)}


@F.pandas_udf(StringType())
def _unquote(s: pd.Series) -> pd.Series:
    return s.map(unquote, na_action="ignore")


def percent_decode(c: Column) -> Column:
    """Percent escapes decoded as UTF-8; bad escapes and ``+`` stay as they are.

    Texts whose escapes are all plain ASCII bytes are decoded by built-in functions; only texts
    with an escape of 0x80 or more, or a stray ``%``, go through Python.
    """
    simple = c.rlike(r"^(?:[^%]|%[0-7][0-9a-fA-F])*$")
    inside = F.when(c.contains("%") & simple, F.replace(c, F.lit("+"), F.lit("%2B"))).otherwise(F.lit(""))
    return F.when(~c.contains("%"), c).when(simple, F.url_decode(inside))


def decoded_text(df: DataFrame, url: str, body: Column, out: str) -> DataFrame:
    """Adds lower-cased, percent-decoded ``url + ' ' + body``."""
    df = df.withColumn("_t", F.lower(F.concat(F.coalesce(F.col(url), F.lit("")), F.lit(" "),
                                              F.coalesce(body, F.lit("")))))
    return with_percent_decoded(df, "_t", out).drop("_t")


def with_percent_decoded(df: DataFrame, col: str, out: str) -> DataFrame:
    """``percent_decode`` with the Python part fed NULL except for the texts that need it."""
    quick = percent_decode(F.col(col))
    df = df.withColumn("_q", quick)
    hard = F.when(F.col("_q").isNull(), F.col(col))
    return df.withColumn("_h", _unquote(hard)).withColumn(out, F.coalesce("_q", "_h")).drop("_q", "_h")


def attack_features(t: Column) -> dict[str, Column]:
    """23 counts over the decoded text."""
    out: dict[str, Column] = {}
    for kind, words in R.FEATURE_KEYWORDS:
        n = F.regexp_count(t, F.lit("|".join(java_quote(w) for w in words)))
        out[f"{kind}_keyword_count"] = n
        out[f"{kind}_detected"] = _flag(n > 0)
    two = lambda a, b: count_text(t, a) + count_text(t, b)
    any_of = lambda ws: sum((_flag(t.contains(w)) for w in ws[1:]), _flag(t.contains(ws[0])))
    out |= {
        "sql_quotes": count_chars(t, "'\""), "sql_comments": two("--", "/*"),
        "sql_semicolons": count_chars(t, ";"), "sql_unions": count_text(t, "union"),
        "xss_script_tags": count_text(t, "<script"),
        "xss_event_handlers": any_of(["onload", "onerror", "onclick"]),
        "xss_javascript": count_text(t, "javascript:"),
        "dir_traversal_dots": two("../", "..\\"),
        "dir_traversal_encoded": count_text(t, "%2e%2e"),
        "cmd_injection_pipes": count_chars(t, "|&"),
        "cmd_injection_backticks": count_chars(t, "`"),
        "cmd_injection_dollar": count_text(t, "$("),
        "file_inclusion_protocols": any_of(["php://", "file://", "data://"]),
    }
    return {k: c.cast("double") for k, c in out.items()}
