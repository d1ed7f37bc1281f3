import datetime as dt

import pytest
from pyspark.sql import functions as F

from stowage.operators.progress import progress_windows
from stowage.plans import analysis_job
from stowage.plans import queries as named
from stowage.session import shared_folder
from stowage.sources import given_tables as given
from stowage.streaming import jobs, tasks

SF = "/root/testdata/sf0.001"
T = dt.datetime(2026, 1, 1)


def _events(frame, rows):
    return frame([(a, i, "progress", T + dt.timedelta(minutes=m), v) for a, i, m, v in rows],
                 "task_id string, event_id bigint, event_type string, ts timestamp, "
                 "files_per_second double")


def test_windows_close_behind_the_watermark(spark, frame, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("a", 1, 5, 1.0), ("a", 2, 50, 2.0), ("b", 3, 70, 4.0), ("a", 4, 400, 8.0)]
    events = _events(frame, rows)
    events.where("event_id < 4").coalesce(1).write.parquet(source)

    def run():
        stream = jobs.stream_table(spark, source)
        jobs.progress_stream(stream, out, state, once=True).awaitTermination()

    run()
    events.where("event_id = 4").coalesce(1).write.mode("append").parquet(source)
    run()
    # A late event of a closed window changes nothing any more.
    _events(frame, [("a", 9, 6, 99.0)]).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {(r["task_id"], r["window_start"], r["event_count"]) for r in
           spark.read.parquet(out).collect()}
    assert got == {("a", T, 2), ("b", T + dt.timedelta(hours=1), 1)}


def test_updates_equal_the_batch_result(spark):
    events = given.task_events(spark, SF)
    streamed = jobs.progress_windows_once(spark, SF)
    batch = progress_windows(events)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_inventory_stream_is_idempotent(spark, frame, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    ddl = "scan_id string, path string, size_bytes bigint"
    frame([("s", "/a", 1), ("t", "/b", 2)], ddl).coalesce(1).write.parquet(source)
    for extra in ([], [("s", "/c", 3)]):
        if extra:
            frame(extra, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_table(spark, source, files_per_trigger=1)
        jobs.inventory_stream(stream, out, state, once=True).awaitTermination()
    assert {r["path"] for r in spark.read.parquet(out).collect()} == {"/a", "/b", "/c"}


def test_snapshot_stream_keeps_the_latest(spark, frame, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    ddl = "volume_id string, snapshot_date date, used_size_bytes bigint, created_at timestamp"
    day = T.date()
    batches = [
        [("a", day, 1, T), ("b", day, 5, T)],
        [("a", day, 2, T + dt.timedelta(hours=2))],
        [("a", day, 3, T + dt.timedelta(hours=1)), ("a", day + dt.timedelta(days=1), 9, T)],
    ]
    for i, rows in enumerate(batches):
        frame(rows, ddl).coalesce(1).write.mode("append" if i else "error").parquet(source)
        stream = jobs.stream_table(spark, source)
        jobs.snapshot_stream(stream, out, state, once=True).awaitTermination()
    got = {(r["volume_id"], str(r["snapshot_date"]), r["used_size_bytes"]) for r in
           spark.read.parquet(out).collect()}
    assert got == {("a", "2026-01-01", 2), ("b", "2026-01-01", 5), ("a", "2026-01-02", 9)}


def test_analysis_refuses_an_open_scan(spark, tmp_path):
    files = given.inventory(spark, SF)
    running = files.select("scan_id").distinct().withColumn("status", F.lit("running"))
    with pytest.raises(ValueError):
        analysis_job.run_analysis(
            spark, files, named._hashed(spark, SF), running, given.snapshots(spark, SF),
            str(tmp_path), given.SCAN_ID, given.AS_OF,
        )


def test_analysis_of_small_scans_again_and_again(spark, frame, tmp_path):
    """Scans without duplicates don't fail, a re-run that finds nothing empties, others stay."""
    files = given.inventory(spark, SF).limit(50)
    both = files.unionByName(files.withColumn("scan_id", F.lit("scan-b")))
    done = both.select("scan_id").distinct().withColumn("status", F.lit("completed_with_warnings"))
    history = given.snapshots(spark, SF)
    ddl = ("scan_id string, file_id string, path string, extension string, size_bytes bigint, "
           "modified_at timestamp, sha256 string")
    pair = frame([("scan-b", f, f"/{f}", ".x", 5000, None, "h") for f in "ab"], ddl)

    def rows(hashed, scan):
        counted = analysis_job.run_analysis(
            spark, both, hashed, done, history, str(tmp_path), scan, given.AS_OF)
        return {r["table_name"]: r["row_count"] for r in counted.collect()}

    first = rows(pair.limit(0), given.SCAN_ID)
    assert first["duplicate_groups"] == 0 and first["scored_files"] == 50 and first["snapshots"] == 1
    assert rows(pair, "scan-b")["duplicate_members"] == 2
    again = rows(pair.limit(0), "scan-b")
    assert again["duplicate_groups"] == again["duplicate_members"] == 0
    assert spark.read.parquet(str(tmp_path / "snapshots")).count() == 2


def test_stored_snapshots_are_the_next_history(spark, tmp_path):
    files = given.inventory(spark, SF).limit(40)
    done = files.select("scan_id").distinct().withColumn("status", F.lit("completed"))
    none = named._hashed(spark, SF).limit(0)
    days = ["2026-01-01", "2026-01-03", "2026-01-05", "2026-01-05"]
    for i, day in enumerate(days):
        grown = files.withColumns({"size_bytes": F.col("size_bytes") + i * 1000, "scan_id": F.lit(f"s{i}")})
        register = done.withColumn("scan_id", F.lit(f"s{i}"))
        counted = analysis_job.run_analysis(
            spark, grown, none, register, None, str(tmp_path), f"s{i}", f"{day} 00:00:00", volume_id="v")
        rows = {r["table_name"]: r["row_count"] for r in counted.collect()}
        assert rows["scored_files"] == 40 and rows["snapshots"] == 1
        assert rows["forecasts"] == (1 if i else 0)
    last = spark.read.parquet(str(tmp_path / "forecasts")).where("scan_id = 's3'").first()
    assert last["series"] == "v" and last["data_points_used"] == 3  # two scans of one day are one point


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_ended_tasks_give_one_row_and_leave_the_state(spark, frame, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    ddl = "task_id string, event_id bigint, event_type string, ts timestamp, files_per_second double"

    def arrive(*rows):
        made = [(t, i, kind, T + dt.timedelta(minutes=m), float(i)) for t, i, kind, m in rows]
        frame(made, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_table(spark, source)
        tasks.task_state_stream(stream, out, state, idle_ms=86_400_000, once=True).awaitTermination()
        ended = spark.read.schema(tasks.OUTPUT).parquet(out).collect()
        open_ = tasks.running_tasks(spark, state).collect()
        return (sorted((r["task_id"], r["event_id"], r["event_count"], r["is_terminal"]) for r in ended),
                {r["task_id"]: r["event_count"] for r in open_})

    # The newest event counts, whatever the order of rows.
    assert arrive(("a", 3, "completed", 9), ("a", 1, "progress", 5), ("b", 2, "progress", 6)) == ([], {"a": 2, "b": 1})
    # A restarted job goes on: the grace is not over, then b goes on working.
    assert arrive(("b", 4, "progress", 100)) == ([], {"a": 2, "b": 2})
    done = [("a", 3, 2, True)]
    assert arrive(("b", 5, "failed", 200), ("c", 6, "progress", 190)) == (done, {"b": 3, "c": 1})
    # Too late for the task that has ended; c falls silent and is closed a day later.
    done = [*done, ("b", 5, 3, True)]
    assert arrive(("a", 7, "progress", 8), ("d", 8, "progress", 400)) == (done, {"c": 1, "d": 1})
    assert arrive(("d", 9, "progress", 1800)) == ([*done, ("c", 6, 1, False)], {"d": 2})
