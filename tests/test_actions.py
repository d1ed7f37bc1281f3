import datetime as dt

import pytest

from stowage import fixed_values as V
from stowage.operators import audit, cleanup, overview, progress, recommendations

CTX = {
    "duplicate_groups": 0, "duplicate_files": 0, "wasted_bytes": 0, "stale_bytes": 0,
    "stale_count": 0, "archive_bytes": 0, "archive_count": 0, "workspace_count": 0,
    "workspace_bytes": 0, "workspace_safe_bytes": 0, "inactive_workspaces": 0, "free_storage": 0,
    "large_file_bytes": 0, "large_file_count": 0,
}


DDL = "scan_id string, " + ", ".join(f"{c} bigint" for c in CTX) + (
    ", daily_growth_bytes double, top_extensions array<string>, by_type array<struct<"
    "workspace_type:string,count:bigint,recoverable_bytes:bigint>>, largest_files "
    "array<struct<path:string,size_bytes:bigint>>")


def _row(scan="s", growth=0.0, extensions=None, types=None, files=None, **given):
    return (scan, *({**CTX, **given}.values()), growth, extensions, types, files)


def _recs(frame, **given):
    recs = recommendations.recommendations(frame([_row(**given)], DDL))
    return recs.orderBy(*recommendations.recommendation_order()).collect()


def test_all_large_files_count(frame):
    """The list that is shown is short; count and bytes are of all files."""
    (rec,) = _recs(frame, files=[(f"/{i}", 2 * V.GIB) for i in range(20)],
                   large_file_count=30, large_file_bytes=60 * V.GIB)
    assert rec["affected_count"] == 30 and rec["recoverable_bytes"] == 60 * V.GIB
    assert rec["title"].startswith("Review 30 files")


def test_nothing_to_recommend(frame):
    assert _recs(frame) == []


THRESHOLDS = [
    ({"duplicate_groups": 1, "wasted_bytes": 100 * V.KIB}, 1),
    ({"duplicate_groups": 1, "wasted_bytes": 100 * V.KIB - 1}, 0),
    ({"duplicate_groups": 0, "wasted_bytes": V.GIB}, 0),
    ({"archive_bytes": V.MIB}, 0), ({"archive_bytes": V.MIB + 1}, 1),
    ({"stale_bytes": 5 * V.MIB}, 0), ({"stale_bytes": 5 * V.MIB + 1}, 1),
    ({"workspace_safe_bytes": 10 * V.MIB}, 0), ({"workspace_safe_bytes": 10 * V.MIB + 1}, 1),
    ({"inactive_workspaces": 1}, 0), ({"inactive_workspaces": 2}, 1),
    ({"free_storage": 180, "growth": 1.0}, 1), ({"free_storage": 181, "growth": 1.0}, 0),
    ({"free_storage": 0, "growth": 1.0}, 0), ({"free_storage": 5, "growth": 0.0}, 0),
    ({"files": [("/a", V.GIB)]}, 0), ({"files": [("/a", V.GIB + 1), ("/b", 1)], "large_file_count": 1, "large_file_bytes": V.GIB + 1}, 1),
    ({"types": [("node", 2, 100 * V.MIB)]}, 0), ({"types": [("node", 2, 100 * V.MIB + 1)]}, 1),
]


def test_thresholds(frame):
    """One context per case, all of them in one run."""
    rows = [_row(scan=str(i), **given) for i, (given, _) in enumerate(THRESHOLDS)]
    made = recommendations.recommendations(frame(rows, DDL)).groupBy("scan_id").count().collect()
    counts = {r["scan_id"]: r["count"] for r in made}
    assert [counts.get(str(i), 0) for i in range(len(rows))] == [n for _, n in THRESHOLDS]


def test_texts_and_order(frame):
    recs = _recs(
        frame, growth=10.0, extensions=[".a", ".b"], types=[("ml", 3, V.GIB)],
        files=[("/big", 2 * V.GIB)], large_file_bytes=2 * V.GIB, large_file_count=1,
        duplicate_groups=3, duplicate_files=7, wasted_bytes=V.GIB,
        archive_bytes=60 * V.GIB, archive_count=4, free_storage=250,
    )
    assert [r["priority"] for r in recs] == ["critical", "critical", "high", "high", "medium"]
    by = {r["category"]: r for r in recs}
    assert by["growth_warning"]["title"] == "Disk may be full in 25 days"
    assert by["growth_warning"]["risk_level"] == "high"
    assert by["duplicate_cleanup"]["title"] == "Remove 3 duplicate file groups"
    assert "types: .a, .b." in by["duplicate_cleanup"]["explanation"]
    assert by["workspace_cleanup"]["title"] == "Clean ml workspace artifacts (1.0 GB)"
    assert by["workspace_cleanup"]["risk_level"] == "medium"
    assert by["large_file"]["affected_paths"] == ["/big"]
    assert by["archive"]["description"].startswith("4 files (60.0 GB) have not been accessed")
    plain = _recs(frame, duplicate_groups=1, wasted_bytes=V.GIB)
    assert "types: various." in plain[0]["explanation"]


def test_decisions(frame):
    recs = frame([("r1", "pending"), ("r2", "pending")], "recommendation_id string, status string")
    decisions = frame([("r1", "accepted", None, 1), ("r1", "dismissed", "no", 2), ("x", "accepted", None, 1)],
                      "recommendation_id string, status string, reason string, decided_at bigint")
    got = {r["recommendation_id"]: (r["status"], r["dismissed_reason"]) for r in
           recommendations.apply_decisions(recs, decisions).collect()}
    assert got == {"r1": ("dismissed", "no"), "r2": ("pending", None)}
    assert recommendations.unknown_decisions(recs, decisions).count() == 1


def test_transitions_across_buckets(frame):
    t = dt.datetime(2026, 1, 1)
    hours = [0, 1, 30, 30, 75]
    steps = ["proposed", "approved", "executing", "completed", "rolled_back"]
    rows = [("a", i, s, t + dt.timedelta(hours=h)) for i, (s, h) in enumerate(zip(steps, hours))]
    rows += [("b", 9, "approved", t), ("b", 10, "completed", t + dt.timedelta(hours=9))]
    events = frame(rows, "action_id string, event_id bigint, status string, ts timestamp")
    for bucket in ("minute", "hour", "day", "year"):
        checked = cleanup.check_transitions(cleanup.transitions(events, bucket)).collect()
        bad = {(r["action_id"], r["from_status"], r["to_status"]) for r in checked
               if not r["is_allowed"]}
        assert bad == {("b", None, "approved"), ("b", "approved", "completed")}
    states = {r["action_id"]: r["status"] for r in cleanup.action_states(events).collect()}
    assert states == {"a": "rolled_back", "b": "completed"}


def test_plan_and_dry_run(frame):
    targets = frame([("/a", 5), ("/gone", 6), ("/dir", 0)], "path string, size_bytes bigint")
    plan = cleanup.propose(targets, "act", "trash")
    assert cleanup.proposal_totals(plan).first()["total_bytes"] == 11
    now = frame([("/a", 7)], "path string, size_bytes bigint")
    rollup = frame([("/dir", 100, 4)], "path string, total_size_bytes bigint, file_count bigint")
    row = cleanup.dry_run(cleanup.dry_run_targets(plan, now, rollup)).first()
    assert (row["valid_count"], row["missing_count"], row["valid_bytes"]) == (2, 1, 107)
    with pytest.raises(ValueError):
        cleanup.propose(targets, "act", "shred")


def test_outcomes(frame):
    ddl = "action_id string, path string, size_bytes bigint, succeeded boolean"
    results = frame([("a", "/1", 5, True), ("a", "/2", 6, False), ("b", "/3", 7, False),
                     ("c", "/4", 8, True)], ddl)
    got = {r["action_id"]: (r["status"], r["files_processed"], r["bytes_recovered"], r["message"])
           for r in cleanup.action_outcomes(results).collect()}
    assert got == {"a": ("completed", 1, 5, "1 files skipped"), "b": ("failed", 0, 0, None),
                   "c": ("completed", 1, 8, None)}


def test_audit(frame):
    ddl = ("log_id string, correlation_id string, action string, entity_type string, "
           "entity_id string, bytes_affected bigint, severity string, created_at timestamp, "
           "paths array<string>")
    t = dt.datetime(2026, 1, 1)
    log = audit.audit_records(frame(
        [("1", "c", "moved", "file", "e", 5, "info", t, [str(i) for i in range(80)]),
         ("2", "d", "failed", "file", "e", 0, "error", t, None)], ddl))
    assert len(log.where("log_id = '1'").first()["paths_affected"]) == 50
    assert audit.query_audit(log, severity="error", entity_id="e").count() == 1
    assert audit.query_audit(log).count() == 2


def test_progress(frame):
    t = dt.datetime(2026, 1, 1)
    events = frame([("a", 1, "progress", t, 10.26), ("a", 2, "completed", t, 9.0),
                    ("b", 3, "progress", t, 1.04)],
                   "task_id string, event_id bigint, event_type string, ts timestamp, "
                   "files_per_second double")
    got = {r["task_id"]: (r["event_id"], r["is_terminal"], r["files_per_second"]) for r in
           progress.task_progress(events).collect()}
    assert got == {"a": (2, True, 9.0), "b": (3, False, 1.0)}
    assert progress.events_after(events, "a", 1).count() == 1


ENDED = dt.datetime(2026, 1, 2, 3, 4, 5)


def test_overview_of_an_empty_scan(frame):
    register = frame([("r", "/", "completed_with_warnings", ENDED), ("q", "/", "running", None)],
                     "scan_id string, root_path string, status string, completed_at timestamp")
    row = overview.overview(
        frame([], "scan_id string, size_bytes bigint, is_stale boolean"),
        frame([], "scan_id string, path string"),
        frame([], "scan_id string, wasted_bytes bigint"),
        frame([], "scan_id string, recoverable_bytes bigint"), "s", 100, scans=register,
    )
    first = row.first()
    assert first["last_scan_at"] == ENDED.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    assert (first["file_count"], first["free_storage"], first["recovery_opportunities"]) == (0, 100, 0)
    assert overview.storage_health(row).first()["headline"] == "scanned"


@pytest.mark.parametrize("free,headline", [(4, "almost_full"), (9, "low_space"), (10, "recoverable")])
def test_health(frame, free, headline):
    row = frame([("s", 100, free, 5, 0, 5)], "scan_id string, total_storage bigint, "
                "free_storage bigint, duplicate_waste bigint, stale_files_size bigint, "
                "recovery_opportunities bigint")
    assert overview.storage_health(row).first()["headline"] == headline
