"""Python-flavoured patterns as Spark (Java) expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_NAMED = re.compile(r"\(\?P<([A-Za-z_]\w*)>")
_BACK = re.compile(r"\(\?P=([A-Za-z_]\w*)\)")


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Same matches in Java: Unicode classes, only ``\\n`` ends a line; named groups become numbered ones."""
    if "(?P" in pattern:
        numbers = re.compile(pattern).groupindex
        pattern = _BACK.sub(lambda m: f"\\{numbers[m[1]]}(?:)", _NAMED.sub("(", pattern))
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)
    return f"(?{'iu' if ignore_case else ''}dU)" + pattern.replace("${", r"$\{")


def can_combine(pattern: str) -> bool:
    """Whether the pattern keeps its meaning as one branch of an alternation."""
    return not re.search(r"\\[1-9]|\(\?P|\(\?[aiLmsux-]+\)|\(\?\(", pattern)


def is_valid(pattern: str) -> bool:
    """Whether Python and, where a session runs, Java take the pattern."""
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern, True))
        return True
    except Exception:  # PatternSyntaxException by way of Py4J
        return False


def search(col, pattern: str, ignore_case: bool = False) -> Column:
    return F.col(col).rlike(java_pattern(pattern, ignore_case)) if isinstance(col, str) \
        else col.rlike(java_pattern(pattern, ignore_case))


def any_word(col: Column, words: list[str]) -> Column:
    """True when the (already lower-cased) text contains one of the literal words."""
    return col.rlike("|".join(java_quote(w) for w in words))


def java_quote(word: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", word)


def count_text(col: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(col, F.lit(java_quote(word)))


def count_chars(col: Column, chars: str) -> Column:
    """How many characters of the text belong to ``chars``."""
    return F.length(col) - F.length(F.translate(col, chars, ""))


def named_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """Positional form of a pattern with named groups plus name -> group number."""
    compiled = re.compile(pattern)  # raises re.error for an unusable format
    return _NAMED.sub("(", pattern), dict(compiled.groupindex)


_SEP = "\x1f"


def match_groups(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of a prefix match as an array; only meaningful where the text matches.

    One pass of the pattern fetches all groups: the match is rewritten to the groups joined by a
    separator.  Texts that hold the separator themselves are taken group by group.
    """
    java = java_pattern(f"^(?:{pattern})")
    joined = F.regexp_replace(text, java + r"(?s:.*)\z", _SEP.join(f"${i}" for i in range(1, n + 1)))
    return (F.when(text.contains(_SEP), F.array(*[F.regexp_extract(text, java, i) for i in range(1, n + 1)]))
             .otherwise(F.split(joined, _SEP)))


def settle(df, keep: list[str], cols: dict[str, Column]):
    """Columns worked out once per row, whatever later filters and projections do with them.

    Catalyst moves filters below projections by repeating the projected expression; behind a
    one-row generator they stay above it.
    """
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*keep, F.inline(F.array(row)).alias(*cols))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]
