"""Rule sets of any length: a text is searched once for literals, and only rules whose literal occurs are tried.

Most patterns cannot match without some literal: ``union.*select`` needs ``union`` and ``select``.  ``factors`` reads
such literals off a pattern, ``occurring`` finds all literals of a rule set in one pass over the text, and
``first_rule`` tries the patterns they belong to, in rule order.  The cost of a row grows with the literals it holds,
not with the rules.
"""

from __future__ import annotations

import json
import re
from re import _constants as OP
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import java_pattern, java_quote, let

SHORTEST, LONGEST = 2, 16
_ZERO_WIDTH = (OP.AT, OP.ASSERT, OP.ASSERT_NOT)
_REPEATS = (OP.MAX_REPEAT, OP.MIN_REPEAT, OP.POSSESSIVE_REPEAT)


def factors(pattern: str) -> frozenset[str] | None:
    """Lower-case ASCII literals of which every match holds at least one, whatever its case; None if there are none of
    ``SHORTEST`` characters.  Longer ones are cut to ``LONGEST``."""
    found = _required(_parser.parse(pattern, re.I))
    return found and frozenset(w[:LONGEST] for w in found)


def _required(nodes) -> frozenset[str] | None:
    options: list[frozenset[str]] = []
    run: list[str] = []

    def close():
        if len(run) >= SHORTEST:
            options.append(frozenset(["".join(run)]))
        run.clear()

    def walk(nodes):
        for op, arg in nodes:
            if op is OP.LITERAL and arg < 128:
                run.append(chr(arg).lower())
            elif op in _ZERO_WIDTH:
                continue
            elif op is OP.SUBPATTERN:
                walk(arg[3])
            elif op is OP.ATOMIC_GROUP:
                walk(arg)
            elif op in _REPEATS and arg[0] > 0:
                walk(arg[2])  # once: the first copy stands behind what precedes it
                close()
            else:
                close()
                if op is OP.BRANCH:
                    each = [_required(branch) for branch in arg[1]]
                    if all(each):
                        options.append(frozenset().union(*each))

    walk(nodes)
    close()
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def folded(text: Column) -> Column:
    """Lower case; the four other characters that match an ASCII letter when case is ignored become that letter."""
    return F.lower(F.translate(text, "ſKıİ", "skii"))


def trie(words: list[str]) -> str:
    """A pattern for the longest of ``words`` that begins at a place."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        branches = [java_quote(c) + text(node[c]) for c in sorted(node) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + "?" if "" in node else body

    return text(root)


def occurring(text: Column, words: list[str]) -> Column:
    """At every place of the folded text the longest of ``words`` that begins there, each once."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(f"(?s)(?=({trie(words)}))"), F.lit(1)))


def first_rule(fields: list[Column], patterns: dict[int, str], needs: dict[int, frozenset[str]]) -> Column:
    """The least number of a pattern that matches one of ``fields`` (not null), null if none does.  ``needs`` holds the
    factors of each pattern."""
    words = sorted(set().union(*needs.values()))
    numbers = sorted(patterns)
    # a word found stands for its beginnings too
    owners: dict[str, list[int]] = {w: [] for w in words}
    for at, i in enumerate(numbers):
        for w in needs[i]:
            owners[w].append(at)
    rules_of = [sorted({at for n in range(SHORTEST, len(w) + 1) for at in owners.get(w[:n], [])}) for w in words]
    # constants that the optimizer works out once; a literal an element would take a call to the JVM each
    by_word = F.from_json(F.lit(json.dumps({w: ",".join(map(str, r)) for w, r in zip(words, rules_of)})), "map<string,string>")
    texts = F.from_json(F.lit(json.dumps([java_pattern(patterns[i], True) for i in numbers])), "array<string>")
    whole = F.concat_ws("\n", *fields)

    def tried(candidates: Column) -> Column:
        def step(best: Column, at: Column) -> Column:
            hit = F.lit(False)
            for f in fields:
                hit = hit | F.regexp_like(f, F.get(texts, at))
            return F.coalesce(best, F.when(hit, at))
        return F.aggregate(candidates, F.lit(None).cast("int"), step)

    candidates = F.array_sort(F.array_distinct(F.flatten(F.transform(occurring(whole, words), lambda w: F.split(F.element_at(by_word, w), ",").cast("array<int>")))))
    return F.get(F.from_json(F.lit(json.dumps(numbers)), "array<int>"), let(candidates, tried))
