import os

from pyspark.sql import functions as F

from stowage.functions.paths import with_path_parts
from stowage.operators import breakdowns, exclusions, folders, paging, scans
from stowage.plans import queries
from stowage.sources import listing, rollups, tables


def _inventory(frame, rows):
    df = frame([("s", str(i), p, n, None) for i, (p, n) in enumerate(rows)],
               "scan_id string, file_id string, path string, size_bytes bigint, "
               "modified_at timestamp")
    return with_path_parts(df)


SAMPLE = [
    ("/home/a.mp4", 1_000_000), ("/home/b.mp4", 2_000_000), ("/home/pics/c.jpg", 50_000),
    ("/home/src/app/main.py", 5_000), ("/home/src/app/util.py", 3_000), ("/home/doc/t.pdf", 500_000),
    ("/home/doc/x", 7),
]


def test_breakdowns_sum_to_total(frame):
    files = _inventory(frame, SAMPLE)
    total = breakdowns.total_stats(files, "s").first()
    assert total == (7, sum(n for _, n in SAMPLE))
    by_category = {r["category"]: r["total_bytes"] for r in
                   breakdowns.category_breakdown(files, "s").collect()}
    assert by_category == {"video": 3_000_000, "image": 50_000, "code": 8_000,
                           "document": 500_000, "other": 7}
    shares = breakdowns.with_share(breakdowns.category_breakdown(files)).collect()
    assert abs(sum(r["share_pct"] for r in shares) - 100) < 0.3


def test_empty_scan(frame):
    files = _inventory(frame, SAMPLE)
    assert breakdowns.total_stats(files, "none").first() == (0, 0)
    assert breakdowns.largest_files(files, "none").count() == 0


def test_missing_category_joins_other(frame):
    rows = frame([("s", None, 5), ("s", "other", 7)], "scan_id string, category string, size_bytes bigint")
    assert breakdowns.category_breakdown(rows).collect() == [("other", 12)]


def test_top_lists(frame):
    files = _inventory(frame, SAMPLE)
    top = breakdowns.largest_files(files, "s", 2).collect()
    assert [r["size_bytes"] for r in top] == [2_000_000, 1_000_000]
    exts = breakdowns.extension_breakdown(files, "s", 2).collect()
    assert [r["extension"] for r in exts] == [".mp4", ".pdf"]


def test_top_list_with_ties(frame):
    rows = _inventory(frame, [(f"/d/f{i:03d}", 10) for i in range(50)])
    top = breakdowns.largest_files(rows, "s", 5).collect()
    assert [r["path"] for r in top] == [f"/d/f{i:03d}" for i in range(5)]


def test_folder_rollup(frame):
    files = _inventory(frame, SAMPLE + [("/top", 1)])
    got = {r["path"]: r for r in folders.folder_rollup(files).collect()}
    assert got["/"]["total_size_bytes"] == sum(n for _, n in SAMPLE) + 1
    assert got["/"]["dir_count"] == 5 and got["/"]["parent_path"] is None
    assert got["/home"]["file_count"] == 7 and got["/home"]["depth"] == 1
    assert got["/home/src"]["total_size_bytes"] == 8_000 and got["/home/src"]["dir_count"] == 1
    assert got["/home/src/app"]["parent_path"] == "/home/src"
    below = {r["path"]: r for r in folders.folder_rollup(files, "/home/src").collect()}
    assert set(below) == {"/home/src", "/home/src/app"}
    assert below["/home/src"]["depth"] == 0 and below["/home/src"]["parent_path"] is None
    table = {r["path"] for r in folders.folder_table(files).collect()}
    assert table == set(got)


def test_depth_limit(frame):
    files = _inventory(frame, SAMPLE)
    assert folders.depth_limit(files, 1).count() == 2
    assert folders.depth_limit(files, 1, "/home").count() == 5


RULES = [
    ("node_modules", "name"), ("pyc", "extension"), ("/dev", "path"), ("a/b", "path"),
    (r"\.tmp$", "regex"), (r"/cache\d$", "regex"), ("[", "regex"),
]
PATHS = [
    "/p/node_modules/x.js", "/p/my_node_modules/x.js", "/p/x.PYC", "/home/dev/x", "/dev/null",
    "/q/a/b/c", "/q/aa/b/c", "/q/z.tmp", "/q/cache1/f", "/q/cache12/f", "/p/node_modules",
]


def _kept(df):
    return sorted(r["path"] for r in df.collect())


def test_file_rules(frame, spark):
    files = _inventory(frame, [(p, 1) for p in PATHS])
    rules = exclusions.rule_table(spark, RULES)
    want = sorted([
        "/p/node_modules/x.js", "/p/my_node_modules/x.js", "/home/dev/x", "/q/aa/b/c",
        "/q/cache1/f", "/q/cache12/f",
    ])
    assert _kept(exclusions.exclude_files(files, rules)) == want


def test_subtree_rules(frame, spark):
    files = _inventory(frame, [(p, 1) for p in PATHS])
    rules = exclusions.rule_table(spark, RULES)
    want = sorted([
        "/p/my_node_modules/x.js", "/p/x.PYC", "/home/dev/x", "/q/aa/b/c", "/q/z.tmp",
        "/q/cache12/f", "/p/node_modules",
    ])
    assert _kept(exclusions.exclude_subtrees(files, rules)) == want


def test_substring_rules(frame, spark):
    files = _inventory(frame, [("/home/dev/x", 1), ("/a/x", 1)])
    rules = exclusions.rule_table(spark, [("/dev", "path")])
    assert _kept(exclusions.exclude_files(files, rules, substring=True)) == ["/a/x"]


def test_the_query_excludes_files_by_path_text(frame, spark, tmp_path):
    """A path rule hits where its text stands anywhere in the path, as in the reference."""
    rows = [(order, 0, supplier, 4, 1.0, "1998-01-01", 1, "A", "O") for order in (1, 10, 60, 21) for supplier in (2, 3)]
    rows += [(9, 6, 2, 4, 1.0, "1998-01-01", 1, "A", "O"), (9, 7, 2, 4, 1.0, "1998-01-01", 1, "A", "O")]
    frame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
          "l_shipdate string, l_quantity int, l_returnflag string, l_linestatus string").withColumn(
        "l_shipdate", F.to_date("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = _kept(queries.QUERIES["exclude_files"](spark, str(tmp_path)))
    assert kept == sorted(["/vol2/u1/proj1/docs/f1-0-2-4.py", "/vol2/u10/proj10/docs/f10-0-2-4.py",
                           "/vol2/u10/proj60/docs/f60-0-2-4.py", "/vol2/u21/proj21/docs/f21-0-2-4.py",
                           "/vol3/u21/proj21/docs/f21-0-3-4.py", "/vol2/u9/proj9/.cache/huggingface/m/f9-7-2-4.pt"])


def test_path_texts_are_taken_as_they_are(frame, spark):
    files = frame([("/a/b.c",), ("/a/bxc",), ("/q\\Ex/y",), ("/x/y/",), ("/x/yz",), (None,), ("",)], "path string")
    kept = lambda *texts: [r["path"] for r in exclusions.exclude_files(
        files, exclusions.rule_table(spark, [(t, "path") for t in texts]), substring=True).collect()]
    assert set(kept("b.c", "q\\E", "/y/")) == {"/a/bxc", "/x/yz", None, ""}
    assert set(kept("y", "/A")) == {"/a/b.c", "/a/bxc", None, ""}
    assert kept("") == [None]


def test_any_number_of_rules_and_odd_ones(frame, spark):
    """The root, relative paths, missing paths and patterns that only one regex engine takes."""
    files = frame([("x/z/f.py",), ("/x/y/f.py",), (None,), ("/Ünï/a",)], "path string").withColumn(
        "directory", F.regexp_replace("path", "/[^/]*$", ""))
    many = [(f"n{i}", "name") for i in range(3000)]
    kept = lambda rules: {r["path"] for r in exclusions.exclude_files(
        files, exclusions.rule_table(spark, rules + many)).collect()}
    assert kept([("/", "path")]) == {"x/z/f.py", None}
    assert kept([("/x", "path")]) == {"x/z/f.py", None, "/Ünï/a"}
    assert kept([("x", "path")]) == {None, "/Ünï/a"}
    assert kept([("(?P<n>x)", "regex"), ("[", "regex"), (r"^/\p{Lu}\p{L}+", "regex")]) == {"x/z/f.py", "/x/y/f.py", None}
    tree = exclusions.exclude_subtrees(files, exclusions.rule_table(spark, [("/x", "path"), *many]))
    assert {r["path"] for r in tree.collect()} == {"x/z/f.py", None, "/Ünï/a"}


def test_rule_sources(frame, spark):
    stored = frame([("a", "name", True), ("b", "name", False)],
                   "pattern string, rule_type string, is_active boolean")
    got = {r["pattern"] for r in exclusions.rule_sources(spark, stored, ["tmp"]).collect()}
    assert got == {"/proc", "/sys", "/dev", "/run", "/snap", "a", "tmp"}
    assert exclusions.seeded_rules(spark).count() == 12


def test_paging(frame):
    df = frame([(i,) for i in range(23)], "i int")
    assert [r["i"] for r in paging.page(df, [F.col("i")], 3, 10).collect()] == [20, 21, 22]
    assert paging.page_totals(df, 10).first() == (23, 3)
    after = paging.page_after(df, [F.col("i")], F.col("i") > 4, 2)
    assert [r["i"] for r in after.collect()] == [5, 6]


def test_pages_behind_a_row_and_from_a_stored_ranking(spark, frame, tmp_path):
    rows = [(i % 3, f"k{i % 7}", i) for i in range(230)]
    df = frame(rows, "a int, b string, c bigint")
    order = [("a", True), ("b", False), ("c", False)]
    want = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for at in (0, 77, 228):
        got = paging.page_behind(df, order, want[at], 5).collect()
        assert [tuple(r) for r in got] == want[at + 1 : at + 6]
    columns = [F.col("a").desc(), F.col("b"), F.col("c")]
    paging.write_ranked(df, columns, str(tmp_path), 4)
    for page in (1, 5, 23, 24, 1_000_000):
        found = paging.ranked_page(spark, str(tmp_path), df.schema, page, 10)
        assert [tuple(r) for r in found.collect()] == want[(page - 1) * 10 : page * 10]
    # Only the ranges of the page are read.
    plan = paging.ranked_page(spark, str(tmp_path), df.schema, 23, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan and "Offset" not in plan
    paging.write_ranked(df.limit(0), columns, f"{tmp_path}/none", 4)
    assert paging.ranked_page(spark, f"{tmp_path}/none", df.schema, 1, 10).count() == 0


def test_delta(frame):
    ddl = "path string, size_bytes bigint, modified_at timestamp"
    import datetime as dt

    t0, t1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    old = frame([("/a", 1, t0), ("/b", 1, t0), ("/c", 1, None)], ddl)
    new = frame([("/a", 1, t0), ("/b", 1, t1), ("/d", 9, t1), ("/c", 1, None)], ddl)
    got = {r["path"]: r["change"] for r in scans.inventory_delta(old, new).collect()}
    assert got == {"/a": "unchanged", "/b": "changed", "/c": "unchanged", "/d": "new"}
    back = {r["path"]: r["change"] for r in scans.inventory_delta(new, old).collect()}
    assert back["/d"] == "gone"


def _tree(root):
    for name, size in (("a.txt", 3), ("sub/b.py", 5), ("sub/deep/c", 0), ("sub/deep/er/d.mp4", 7)):
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(b"x" * size)
    os.makedirs(os.path.join(root, "empty"))


def test_listing_of_a_tree(spark, tmp_path):
    root = str(tmp_path)
    _tree(root)
    listed = listing.list_files(spark, root, "s")
    assert {(r["path"], r["size_bytes"], r["category"]) for r in listed.collect()} == {
        (f"{root}/a.txt", 3, "document"), (f"{root}/sub/b.py", 5, "code"),
        (f"{root}/sub/deep/er/d.mp4", 7, "video")}
    assert listed.count() == 3
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_store_replaces_a_scan(spark, frame, tmp_path):
    folder = str(tmp_path / "inventory")
    first = _inventory(frame, SAMPLE)
    tables.write_inventory(first, folder)
    tables.write_inventory(first.withColumn("scan_id", F.lit("t")), folder)
    tables.write_inventory(first.limit(2), folder)
    counts = {r["scan_id"]: r["count"] for r in
              tables.read_inventory(spark, folder).groupBy("scan_id").count().collect()}
    assert counts == {"s": 2, "t": 7}


def test_register_of_odd_scans(frame):
    import datetime as dt

    t0, t1, t2 = (dt.datetime(2026, 1, d) for d in (1, 2, 3))
    register = frame([("a", "/r", "completed", t0, t1, 0, t0), ("b", "/r", "completed_with_warnings", t0, t2, 2, t0),
                      ("c", "/r", "running", t0, None, 0, t0), ("d", "/r", "failed", t0, t1, 0, t0)],
                     "scan_id string, root_path string, status string, started_at timestamp, "
                     "completed_at timestamp, error_count bigint, created_at timestamp")
    assert [r["scan_id"] for r in scans.latest_completed(register).collect()] == ["b"]
    files = frame([("a", 5), ("a", None)], "scan_id string, size_bytes bigint")
    none = frame([], "scan_id string")
    got = {r["scan_id"]: (r["total_files"], r["total_dirs"], r["total_size_bytes"], r["status"])
           for r in scans.scan_totals(files, none, register).collect()}
    assert got == {"a": (2, 0, 5, "completed"), "b": (0, 0, 0, "completed_with_warnings"),
                   "c": (0, 0, 0, "running"), "d": (0, 0, 0, "failed")}


def test_delta_of_unknown_sizes(frame):
    rows = frame([("/a", None, None)], "path string, size_bytes bigint, modified_at timestamp")
    assert [r["change"] for r in scans.inventory_delta(rows, rows).collect()] == ["unchanged"]


def test_a_rollup_follows_its_deltas(spark, frame, tmp_path):
    """Equal to a full rollup after each of three deltas; folders elsewhere are not rewritten."""
    import random

    rng = random.Random(3)
    folder, at = str(tmp_path / "rollup"), {}
    ddl = "scan_id string, path string, directory string, size_bytes bigint, modified_at int"

    def scan():
        rows = [("s", p, p.rsplit("/", 1)[0] or "/", *v) for p, v in at.items()]
        return frame(rows, ddl)

    def path(top):
        return "/".join([top, *(rng.choice("abc") for _ in range(rng.randrange(4))), f"f{rng.randrange(30)}"])

    for i in range(120):
        at[path(rng.choice(["/v1", "/v2", "/v3"]))] = (rng.randrange(100), 0)
    at["/top"] = (1, 0)
    before = scan()
    rollups.write_rollup(folders.folder_rollup(before), folder)
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "rollup" / "area=v3").iterdir()}
    for step in range(3):
        for p in rng.sample([p for p in sorted(at) if p.startswith(("/v1", "/v2"))], 25):
            if rng.random() < 0.6:
                del at[p]
            else:
                at[p] = (rng.randrange(100), step + 1)
        for _ in range(10):
            at[path(rng.choice(["/v1", "/v2/new"]))] = (rng.randrange(100), step + 1)
        after = scan()
        areas = rollups.update_rollup(spark, folder, scans.inventory_delta(before, after))
        assert set(areas) <= {"_", "v1", "v2"}
        want = folders.folder_rollup(after).drop("scan_id")
        got = folders.with_folder_columns(rollups.read_rollup(spark, folder)).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        before = after
    assert kept == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "rollup" / "area=v3").iterdir()}
    at.clear()
    rollups.update_rollup(spark, folder, scans.inventory_delta(before, scan()))
    assert rollups.read_rollup(spark, folder).count() == 0
