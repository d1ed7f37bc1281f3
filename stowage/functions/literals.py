"""Plain texts that every match of a pattern contains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

#: Escapes that stand for a class, an edge or a control character: they end a plain text.
_ESCAPES = set("dDwWsSbBAzZGhHvVRtnrfae")


def _class_end(pattern: str, at: int) -> int | None:
    """The place behind the character class that begins at ``at``."""
    i = at + 1 + (pattern[at + 1 : at + 2] == "^")
    if pattern[i : i + 1] == "]":
        return None
    depth = 1
    while i < len(pattern):
        if pattern.startswith("\\Q", i):
            end = pattern.find("\\E", i)
            i = len(pattern) if end < 0 else end + 2
            continue
        if pattern[i] == "\\":
            i += 2
            continue
        depth += (pattern[i] == "[") - (pattern[i] == "]")
        i += 1
        if not depth:
            return i
    return None


def _quantifier(pattern: str, at: int) -> tuple[int, bool, bool]:
    """The place behind a quantifier, whether there is one, and whether it allows none."""
    c = pattern[at : at + 1]
    if c and c in "*?+":
        end, optional = at + 1, c != "+"
    elif c == "{":
        end = pattern.find("}", at) + 1
        if not end:
            return len(pattern), True, True
        least = pattern[at + 1 : end - 1].split(",")[0]
        optional = not least.isdigit() or int(least) == 0
    else:
        return at, False, False
    while pattern[end : end + 1] in ("?", "+"):
        end += 1
    return end, True, optional


def required_literals(pattern: str, shortest: int = 3) -> list[str] | None:
    """Texts of which every match of a Java pattern contains one; None if that can't be told.

    One text per alternative, its longest run.
    """
    found = required_runs(pattern, shortest)
    return found if found is None else [max(runs, key=len) for runs in found]


def required_runs(pattern: str, shortest: int = 3) -> list[list[str]] | None:
    """Per alternative of a Java pattern the texts that its matches contain all; None if that can't be told."""
    found = alternatives(pattern, shortest)
    return found if found is None else [runs for _, runs in found]


def alternatives(pattern: str, shortest: int = 3) -> list[tuple[str, list[str]]] | None:
    """The alternatives of a Java pattern, each with the texts that its matches contain all; None if that can't be told.

    These are the runs of plain characters outside of groups and classes.
    Where a construct isn't known, the answer is None: a text that isn't needed
    is never given. A pattern has a match where one of its alternatives, as a
    pattern of its own, has one: references, and flags for all that follows, are
    among the constructs that give None.
    """
    found: list[tuple[str, list[str]]] = []
    runs: list[str] = [""]
    depth = begin = i = 0
    while i < len(pattern):
        c, literal = pattern[i], ""
        if pattern.startswith("\\Q", i):
            end = pattern.find("\\E", i)
            literal = pattern[i + 2 : end if end >= 0 else len(pattern)]
            i = end + 2 if end >= 0 else len(pattern)
            if not literal:
                continue
        elif c == "\\":
            escaped = pattern[i + 1 : i + 2]
            if not escaped or (escaped.isalnum() and escaped not in _ESCAPES):
                return None
            literal = "" if escaped.isalnum() else escaped
            i += 2
        elif c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return None
            i = end
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] not in (":", "=", "!", "<", ">"):
                return None
            depth += 1
            i += 1 + 2 * (pattern[i + 1 : i + 2] == "?")
            runs.append("")
            continue
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
            i += 1
        elif c == "|":
            i += 1
            if not depth:
                found.append((pattern[begin:i - 1], [text for text in runs if len(text) >= shortest]))
                runs, begin = [""], i
            continue
        else:
            literal = "" if c in ".^$" else c
            i += 1
        i, quantified, optional = _quantifier(pattern, i)
        if depth:
            continue
        if not literal:
            runs.append("")
            continue
        runs[-1] += literal[:-1] if optional else literal
        if quantified:
            runs.append("")
    if depth:
        return None
    found.append((pattern[begin:], [text for text in runs if len(text) >= shortest]))
    return found if all(runs for _, runs in found) else None


def literals_of(pattern: Column, shortest: int = 3) -> Column:
    """``alternatives`` of a column of distinct patterns."""

    @F.pandas_udf("array<struct<regex string, texts array<string>>>")
    def run(patterns: pd.Series) -> pd.Series:
        named = lambda found: found and [{"regex": regex, "texts": texts} for regex, texts in found]
        return patterns.map(lambda p: named(alternatives(p, shortest)))

    return run(pattern)
