"""Patterns by their plain texts: what is required, and what the index finds."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stowage.functions import grams
from stowage.functions.literals import alternatives, required_literals
from stowage.operators import exclusions, pattern_index


@pytest.mark.parametrize(("pattern", "texts"), [
    ("node_modules", ["node_modules"]), (r"/f1[0-9]*-[0-9-]*\.pdf$", [".pdf"]), (r"^/proj1[0-9]$", ["/proj1"]),
    ("abcd?e", ["abc"]), ("abc+de", ["abc"]), ("abcd{0,2}xyz1", ["xyz1"]), ("abcd{2}x", ["abcd"]),
    ("abc|defg", ["abc", "defg"]), ("(abc|d)efgh", ["efgh"]), ("(?:abcdef)*xyz", ["xyz"]),
    (r"\Qa.b|c\E+d", ["a.b|c"]), (r"\Qabc\E\\E\Qd\E", ["abc\\Ed"]), ("ab]cd", ["ab]cd"]), (r"a\.b\-c", ["a.b-c"]),
    ("abc[x[yz]&&[^a]]def1", ["def1"]), (r"abc[\]]defg", ["defg"]), ("(?<n>abc)defg", ["defg"]),
    ("abc??d+?e++fgh", ["fgh"]), ("ÜñïX", ["ÜñïX"]),
])
def test_required(pattern, texts):
    assert required_literals(pattern) == texts


@pytest.mark.parametrize("pattern", [
    "", "ab", "a.b.c", "(?i)abcdef", "(?x)abc def", r"\x41bcdef", r"abc\1def", r"\p{Lu}abcd", "abc|x", "[", "[]abc]",
    "abc)", "(abc", "abc\\", "abc(?i:d)efg", "[a-z]+", r"\d{3}-\d",
])
def test_not_told(pattern):
    assert required_literals(pattern) is None


_ATOM = st.one_of(
    st.text("abc/.-", min_size=1, max_size=5).map(re.escape), st.sampled_from([".", "[ab]", "[^c/]", r"\d", r"\w"]))
_PART = st.tuples(_ATOM, st.sampled_from(["", "", "", "?", "*", "+", "{0,2}", "{2}", "*?", "+?"])).map("".join)
_PATTERN = st.recursive(
    st.lists(_PART, min_size=1, max_size=4).map("".join),
    lambda inner: st.one_of(
        st.tuples(inner, inner).map("|".join), inner.map("({})".format), inner.map("(?:{})?".format),
        st.tuples(inner, inner).map("".join)), max_leaves=5)


@settings(max_examples=400, deadline=None)
@given(_PATTERN, st.lists(st.text("abc/.-1", max_size=14), max_size=12))
def test_every_match_has_a_required_text(pattern, texts):
    needed = required_literals(pattern, 1)
    for text in texts:
        if needed and re.search(pattern, text):
            assert any(n in text for n in needed)


@settings(max_examples=400, deadline=None)
@given(_PATTERN, st.lists(st.text("abc/.-1", max_size=14), max_size=12))
def test_a_pattern_matches_where_an_alternative_does(pattern, texts):
    for text in texts:
        found = alternatives(pattern, 1)
        if found:
            assert bool(re.search(pattern, text)) == any(re.search(regex, text) for regex, _ in found)


def _paths(n, seed=1):
    rng = random.Random(seed)
    names = ["src", "node_modules", "build", "Ünï", "a.b", "x"]
    return [f"/v{rng.randrange(4)}/{rng.choice(names)}/p{rng.randrange(400)}/{rng.choice(names)}/f{i}.py" for i in range(n)]


def test_ten_thousand_patterns_without_a_nested_loop(spark, frame):
    paths = _paths(3000)
    rules = [(f"/p{i % 500}/[a-z_]+/f{i}\\.(py|js)$", "regex") for i in range(10_000)]
    rules += [("(?i)SRC/f1[0-9]*", "regex"), ("[0-9]{4}", "regex"), ("(", "regex"), ("/none/of/these", "regex")]
    files = frame([(p,) for p in [*paths, None, "", "/", "ab"]], "path string")
    files = files.withColumn("directory", F.regexp_replace("path", "/[^/]*$", ""))
    kept = exclusions.exclude_files(files, exclusions.rule_table(spark, rules))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    hit = {m for p in paths for m in [re.search(r"/p(\d+)/[a-z_]+/f(\d+)\.py$", p)]
           if m and int(m[2]) < 10_000 and int(m[2]) % 500 == int(m[1])}
    gone = {m.string for m in hit} | {p for p in paths if re.search("[0-9]{4}|src/f1", p)}
    assert sorted(r["path"] or "" for r in kept.collect()) == sorted(["", "", "/", "ab"] + [
        p for p in paths if p not in gone])
    tree = exclusions.exclude_subtrees(files, exclusions.rule_table(spark, [("/p1[0-9]{2}/(src|x)$", "regex")]))
    assert {r["path"] for r in tree.collect()} == {None, "", "/", "ab"} | {
        p for p in paths if not re.search("/p1[0-9]{2}/(src|x)/", p)}


def test_open_patterns_are_named_and_bounded(spark, frame, monkeypatch):
    patterns = frame([("[a-z]+",), ("abc",), ("(",), (None,), ("x|yzz",)], "regex string")
    assert sorted(r["regex"] for r in pattern_index.open_patterns(patterns).collect()) == ["[a-z]+", "x|yzz"]
    monkeypatch.setattr(pattern_index, "MAX_OPEN_PATTERNS", 1)
    values = frame([("abc",)], "value string")
    with pytest.raises(Exception, match="more than 1 patterns"):
        pattern_index.matched_values(values, patterns, F.array("value")).collect()


def test_a_pattern_goes_under_its_rarest_piece(spark, frame):
    values = frame([(f"/common/{i}",) for i in range(50)] + [("/common/rare",)], "value string")
    known = pattern_index.with_literals(frame([("/common/rare",), ("/absent/",)], "regex string"))
    rows = pattern_index.pattern_index(values, known).collect()
    assert [(r["literal"], r["piece"] in "/rare") for r in rows] == [("/common/rare", True)]


def test_a_pattern_goes_under_its_rarest_text(frame):
    """The longest plain text is held by all values, a shorter one by one of them."""
    values = frame([(f"/common/{i}/x",) for i in range(50)] + [("/common/51/-77-",)], "value string")
    known = pattern_index.with_literals(frame([("/common/[0-9]+/-77-",)], "regex string"))
    assert [r["literal"] for r in pattern_index.pattern_index(values, known).collect()] == ["/-77-"]


def test_an_alternative_of_many_patterns_is_looked_up_once(spark, frame):
    values = frame([(f"/proj7/cache/-{i}-{j}",) for i in range(20) for j in range(3)], "value string")
    patterns = frame([(f"-{i}-[12]$|/proj[67]/cache/-1[0-9]-|/proj8/(a|b)",) for i in range(10)], "regex string")
    rows = pattern_index.pattern_index(values, pattern_index.with_literals(patterns)).collect()
    assert sorted(r["regex"] for r in rows) == sorted([f"-{i}-[12]$" for i in range(10)] + ["/proj[67]/cache/-1[0-9]-"])
    got = pattern_index.matched_values(values, patterns, F.array("value")).collect()
    assert sorted(r["value"] for r in got) == sorted(
        f"/proj7/cache/-{i}-{j}" for i in range(20) for j in range(3) if i >= 10 or j)


def test_pairs_hold_all_texts_that_an_alternative_needs(spark, frame):
    """The rarest text stands in both values; only one holds the other text too, and no regex is tried on the other."""
    values = frame([("/vol1/u1/proj-77-",), ("/vol2/u1/proj-77-",), ("/vol3",)], "value string")
    patterns = frame([("/vol1/u[0-9]/.*-77-",), ("/vol3/|/vol1/u[0-9]x",)], "regex string")
    index = pattern_index.pattern_index(values, pattern_index.with_literals(patterns)).collect()
    assert {(r["regex"], r["literal"], *r["others"]) for r in index} >= {("/vol1/u[0-9]/.*-77-", "/vol1/u", "-77-")}
    got = pattern_index.matched_values(values, patterns, F.array("value")).collect()
    assert [r["value"] for r in got] == ["/vol1/u1/proj-77-"]


def test_keys_are_made_only_of_kinds_with_rules(spark, frame):
    files = frame([("/a/src/x.py",), ("/a/b/y.js",), (None,)], "path string")
    kept = lambda rules: exclusions.exclude_files(files, exclusions.rule_table(spark, rules))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    patterns = kept([("/src/[a-z]", "regex")])
    assert "LeftSemi" not in plan(patterns) and "LeftSemi" in plan(kept([("/src/[a-z]", "regex"), ("x", "name")]))
    assert {r["path"] for r in patterns.collect()} == {"/a/b/y.js", None}
    assert {r["path"] for r in kept([("js", "extension")]).collect()} == {"/a/src/x.py", None}
    assert kept([]).count() == 3


@pytest.mark.parametrize("texts", [
    [b"/a/b", b"", b"c"], ["/Ünï/ab".encode(), b"/a", "ß€😀".encode()], [b"ab\xff", b"cd"], ["Ü".encode()[:1], "Ü".encode()[1:], b"x"], [b""],
])
def test_code_points_of_odd_texts(texts):
    joined, points, starts = grams._points(pa.array([b"skipped", *texts], pa.binary()).slice(1))
    want = [t.decode("utf-8", "replace") for t in texts]
    assert joined == "".join(want) and points.tolist() == [ord(c) for c in joined]
    assert np.diff(starts).tolist() == [len(t) for t in want] and starts[0] == 0


def test_only_wanted_pieces_leave_the_task(frame):
    values = frame([(f"/Ünï/{i}/x",) for i in range(2000)] + [(None,), ("",), ("ab",)], "value string")
    wanted = grams.with_slots(frame([("/77/",), ("ï/1",)], "piece string"), "piece", 16, 2)
    got = {(r["value"], r["piece"]) for r in grams.with_runs(values, grams.bitmap_of(wanted, 16), 16, 2).collect()}
    needed = {(f"/Ünï/{i}/x", p) for i in range(2000) for p in ("/77/", "ï/1") if p in f"/Ünï/{i}/x"}
    assert needed <= got and len(got) < len(needed) + 50


def test_keys_that_no_rule_equals_are_not_shuffled(spark, frame):
    rules = exclusions.rule_table(spark, [("src", "name"), ("/v1/x", "path"), ("p7/build", "path")])
    named = exclusions._rules_of(rules, "name", "path")
    keys = exclusions._folder_keys(frame([(p,) for p in _paths(500)], "path string"), F.lit(2), F.lit(2)).withColumn(
        "kind", F.lit("path"))
    kept = keys.where(exclusions._has_slot(exclusions._slots_of(named).scalar())).select("pattern").distinct().collect()
    held = {p for p in ("/v1/x", "p7/build") if any(p in path for path in _paths(500))}
    assert held <= {r["pattern"] for r in kept} and len(kept) < 10
