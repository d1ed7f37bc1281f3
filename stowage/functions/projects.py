"""Workspace expressions: artifact matching, roots and project names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stowage import fixed_values as V


def artifact_rule(path: str, patterns: list[tuple] | None = None) -> Column:
    """Number (from 1) of the first pattern that the named column contains, else NULL.

    A pattern counts only if its first occurrence has something other than
    ``/`` before it. All patterns start with a slash, so in an absolute path
    that is an occurrence after position 2. The column is read once per
    pattern, so it should be a plain one (see ``computed_once``).
    """
    arms = " ".join(
        f"WHEN instr({path}, '{row[0]}') > 2 THEN {number}"
        for number, row in enumerate(patterns or V.WORKSPACE_PATTERNS, 1)
    )
    return F.expr(f"CASE {arms} END")


def searchable(path: Column) -> Column:
    """An absolute path as it is, a relative one moved by one character."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("."), path))


def rule_value(rule: str, position: int, patterns: list[tuple] | None = None) -> Column:
    """One attribute of the pattern whose number is in the named column."""
    values = [row[position] for row in patterns or V.WORKSPACE_PATTERNS]
    texts = ", ".join(str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in values)
    return F.expr(f"get(array({texts}), {rule} - 1)")


def workspace_root(path: str, rule: str, patterns: list[tuple] | None = None) -> Column:
    """What stands before the first occurrence of the matched pattern."""
    at = F.call_function("instr", F.col(path), rule_value(rule, 0, patterns))
    return F.left(F.col(path), at - 1)


def model_extension(path: Column) -> Column:
    """Lower-case suffix after the last dot of the last component, else NULL."""
    name = F.substring_index(path, "/", -1)
    tail = F.substring_index(name, ".", -1)
    return F.when(F.length(tail) < F.length(name), F.concat(F.lit("."), F.lower(tail)))


def workspace_risk(workspace_type: Column) -> Column:
    return F.when(workspace_type.isin(V.MEDIUM_RISK_WORKSPACES), "medium").otherwise("low")


def project_name_key(name: Column) -> Column:
    """Project name without the suffixes that mark a copy; ``""`` if too short."""
    key = F.trim(F.lower(name))
    for pattern in V.PROJECT_SUFFIX_PATTERNS:
        key = F.regexp_replace(key, pattern, "")
    return F.when(F.length(name) < 2, "").otherwise(F.btrim(key, F.lit("-_ ")))


def inactivity_bucket(days: Column) -> Column:
    """Half a year, a year, two years or more without a change."""
    chain = None
    for label, below in V.INACTIVITY_BUCKETS:
        test = days < below
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise("over_2_years")
