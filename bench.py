"""Times the headline queries and prints one JSON line.

The inventory is first stored the way the library stores it (a partition per
scan), with its folder table beside it; the seven headline queries then run
on these tables, each five times after a warm-up, and the median counts. The
jobs are heavier operators over the stored inventory or, in part, over the
given tables themselves; each runs twice and the better time counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from stowage.operators import breakdowns, folders, snapshots, staleness, workspaces  # noqa: E402
from stowage.plans.queries import queries  # noqa: E402
from stowage.session import build_session  # noqa: E402
from stowage.sources import given_tables as given, tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
JOBS = ["dup_groups", "dup_removable", "forecast_auto", "overview", "recommendations"]


def _run(make) -> float:
    start = time.perf_counter()
    make().collect()
    return time.perf_counter() - start


def _write(make) -> float:
    """Time to compute all rows without bringing them to the driver."""
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def _store(spark, work: str):
    """Writes inventory and folders in one file per core, as a cluster would in many."""
    files = given.inventory(spark, SF_DIR).repartition(int(CPUS), "file_id")
    tables.write_inventory(files, f"{work}/inventory")
    stored = tables.read_inventory(spark, f"{work}/inventory")
    rollup = folders.folder_rollup(stored).repartition(int(CPUS), "path")
    tables.replace_partitions(rollup, f"{work}/folders", "scan_id")
    return stored, spark.read.parquet(f"{work}/folders")


def _overview(files, dirs):
    """Totals, breakdowns and folder count in one plan, as the dashboard asks for them.

    The operator of that name, which also looks for duplicates and old files, is ``job_overview``.
    """
    cube = snapshots.category_extension_cube(breakdowns.of_scan(files, given.SCAN_ID))
    counted = breakdowns.folder_count(dirs, given.SCAN_ID)
    return cube.withColumn("dir_count", counted.scalar())


def main() -> None:
    work = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "stowage-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": work,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    files, dirs = _store(spark, work)
    stored = time.perf_counter() - start
    scan = given.SCAN_ID
    headline = {
        "largest_files_100": lambda: breakdowns.largest_files(files, scan, 100),
        "largest_files_10": lambda: breakdowns.largest_files(files, scan, 10),
        "category_breakdown": lambda: breakdowns.category_breakdown(files, scan),
        "extension_breakdown_20": lambda: breakdowns.extension_breakdown(files, scan, 20),
        "total_stats": lambda: breakdowns.total_stats(files, scan),
        "largest_folders_50": lambda: breakdowns.largest_folders(dirs, scan, 50),
        "full_overview": lambda: _overview(files, dirs),
    }
    for _ in range(6):
        for make in headline.values():
            _run(make)
    times = {
        name: round(statistics.median(_run(make) for _ in range(5)), 4)
        for name, make in headline.items()
    }
    total = round(sum(times.values()), 4)
    # What any query costs here: a job over one row, with one exchange.
    empty = lambda: spark.range(1).groupBy("id").count()
    times["floor_one_row_job"] = round(statistics.median(_run(empty) for _ in range(7)), 4)
    named = queries()
    artifacts = workspaces.artifact_files(files, scan)
    jobs = {
        "folder_rollup": lambda: folders.folder_rollup(files),
        "stale_summary": lambda: staleness.stale_summary(
            staleness.score_files(files, given.AS_OF), scan
        ),
        "artifact_summary": lambda: staleness.artifact_summary(files, scan),
        "workspaces": lambda: workspaces.workspaces(artifacts),
        **{name: (lambda n=name: named[n](spark, SF_DIR)) for name in JOBS},
    }
    for name, make in jobs.items():
        times[f"job_{name}"] = round(min(_write(make) for _ in range(2)), 3)
    times["job_store_inventory"] = round(stored, 3)
    print(
        json.dumps(
            {
                "metric": "sum of medians of the seven headline queries",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1],
                "inventory_rows": files.count(),
                "cpus": int(CPUS),
                "spark": pyspark.__version__,
                "shuffle_partitions": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
