import datetime as dt

from stowage.operators import staleness, workspaces

DDL = "scan_id string, file_id string, path string, size_bytes bigint, modified_at timestamp"
AS_OF = "2026-06-01 00:00:00"
NEW, OLD = dt.datetime(2026, 5, 20), dt.datetime(2025, 1, 1)


def _found(frame, rows):
    files = frame([("s", f"{i:02d}", p, n, t) for i, (p, n, t) in enumerate(rows)], DDL)
    artifacts = workspaces.artifact_files(files)
    spaces = workspaces.with_activity(workspaces.workspaces(artifacts), AS_OF)
    return artifacts, spaces, {r["path"]: r for r in spaces.collect()}


def test_roots_types_and_bytes(frame):
    _, _, got = _found(frame, [
        ("/p/web/node_modules/a.js", 5000, NEW), ("/p/web/node_modules/b.js", 8000, OLD),
        ("/p/web/dist/c.js", 100, OLD),
        ("/p/api/.venv/lib/x.py", 10, OLD), ("/p/api/node_modules/.venv/y.py", 1, OLD),
        ("/node_modules/z.js", 7, NEW), ("/p/models/m.pt", 70, NEW), ("/p/src/main.py", 9, NEW),
    ])
    web = got["/p/web"]
    assert (web["recoverable_bytes"], web["safe_recoverable_bytes"]) == (13100, 13000)
    assert web["name"] == "web" and web["workspace_type"] == "node" and web["is_active"]
    assert [a["type"] for a in web["artifacts"]] == ["node_modules", "dist"]
    # The earlier pattern wins, and its root is what stands before it.
    assert "/p/api/node_modules" in got and got["/p/api"]["workspace_type"] == "python"
    assert got["/p/models"]["workspace_type"] == "ml" and got["/p/models"]["risk_level"] == "medium"
    assert "" not in got and "/p/src" not in got


def test_relative_paths_and_single_characters(frame):
    _, _, got = _found(frame, [("a/.venv/x", 1, NEW), ("/.venv/x", 1, NEW), ("//.venv/x", 1, NEW)])
    assert set(got) == {"a"}


def test_models_win_the_type(frame):
    _, _, got = _found(frame, [("/p/a/.venv/x.py", 1, NEW), ("/p/a/w.onnx", 5, OLD)])
    assert got["/p/a"]["workspace_type"] == "ml"
    assert got["/p/a"]["last_modified_at"] == NEW


def test_last_file_decides_the_type(frame):
    _, _, got = _found(frame, [("/p/a/node_modules/x", 1, NEW), ("/p/a/.idea/y", 1, NEW)])
    assert got["/p/a"]["workspace_type"] == "ide"


def test_activity(frame):
    _, spaces, got = _found(frame, [
        ("/p/new/.tox/x", 1, NEW), ("/p/old/.tox/x", 1, OLD), ("/p/none/.tox/x", 1, None),
        ("/p/edge/.tox/x", 1, dt.datetime(2025, 12, 3)),
    ])
    assert got["/p/new"]["is_active"] and not got["/p/old"]["is_active"]
    assert got["/p/none"]["days_inactive"] == 9999 and not got["/p/none"]["is_active"]
    assert got["/p/edge"]["days_inactive"] == 180 and not got["/p/edge"]["is_active"]
    gone = workspaces.abandoned_projects(spaces).collect()
    assert {r["abandoned_count"] for r in gone} == {3}
    total = [r for r in workspaces.workspace_summary(spaces).collect() if r[0] is None][0]
    assert (total["workspace_count"], total["inactive_count"]) == (4, 3)


def test_lookalikes(frame):
    rows = [("/d/project", "project"), ("/e/project-copy", "project-copy"),
            ("/f/project-2", "project-2"), ("/g/other", "other"), ("/h/x", "x"), ("/i/x", "x")]
    got = workspaces.lookalike_projects(frame(rows, "path string, name string")).collect()
    assert {(r["path"], r["group_size"]) for r in got} == {
        ("/d/project", 3), ("/e/project-copy", 3), ("/f/project-2", 3)}


def test_hoarding(frame):
    artifacts, _, _ = _found(frame, [("/m/a.pt", 10, OLD), ("/m/b.pt", 30, NEW), ("/n/c.pt", 5, NEW)])
    got = workspaces.model_hoarding(artifacts).collect()
    assert [(r["path"], r["model_count"], r["redundant_bytes"]) for r in got] == [("/m", 2, 10)]


def test_artifact_summary_counts_overlaps(frame):
    ddl = "path string, size_bytes bigint"
    rows = [("/p/.venv/x", 1), ("/p/venv/x", 2), ("/p/.venv/a/venv/x", 4), ("/p/BUILD/dist/x", 8),
            ("/p/node-modules/x", 16), ("/p/src/x", 32)]
    got = {r["artifact_type"]: (r["file_count"], r["total_bytes"])
           for r in staleness.artifact_summary(frame(rows, ddl)).collect()}
    assert got == {"python_venv": (4, 11), "build_output": (2, 16), "node_modules": (1, 16)}


def test_stale_listing_and_summary(frame):
    ddl = ("scan_id string, file_id string, path string, size_bytes bigint, category string, "
           "accessed_at timestamp, modified_at timestamp")
    def age(days):
        return dt.datetime(2026, 6, 1) - dt.timedelta(days=days)
    rows = [("s", str(i), f"/a/{i}", 10 * (i + 1), c, age(d), age(d))
            for i, (c, d) in enumerate([("code", 1), ("video", 100), ("code", 200), ("other", 900)])]
    rows.append(("s", "9", "/a/9", 1, "code", None, None))
    scored = staleness.score_files(frame(rows, ddl), AS_OF)
    tiers = {r["tier"]: r["file_count"] for r in staleness.stale_summary(scored).collect()}
    assert tiers == {"active": 1, "aging": 1, "stale": 1, "archive_candidate": 2}
    assert staleness.stale_files(scored).count() == 3
    assert staleness.stale_files(scored, tier="aging").count() == 0
    assert staleness.stale_files(scored, category="code", min_size=20).count() == 1
    empty = staleness.stale_summary(scored.where("false")).collect()
    assert len(empty) == 4 and all(r["file_count"] == 0 for r in empty)
