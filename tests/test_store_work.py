"""Stored tables are written without work that grows beyond their rows."""

from stowage.plans import queries
from stowage.sources import commits, rollups, tables


def test_an_update_compares_the_inventories_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def row(path):
        seen.add(1)
        return (path, "new", None, 5)

    folder = str(tmp_path / "rollup")
    first = spark.createDataFrame([("/", 1, 1, 1), ("/a", 1, 1, 0)], "path string, total_size_bytes bigint, file_count bigint, dir_count bigint")
    rollups.write_rollup(first, folder)
    paths = spark.sparkContext.parallelize(["/a/x", "/b/c/y"], 1).map(row)
    delta = spark.createDataFrame(paths, "path string, change string, old_size_bytes bigint, size_bytes bigint")
    assert sorted(rollups.update_rollup(spark, folder, delta)) == ["_", "a", "b"]
    assert seen.value == 2
    assert {(r["path"], r["total_size_bytes"], r["file_count"], r["dir_count"]) for r in
            rollups.read_rollup(spark, folder).collect()} == {("/", 11, 3, 3), ("/a", 6, 2, 0), ("/b", 5, 1, 1), ("/b/c", 5, 1, 0)}
    assert commits.Store(spark, folder).names(commits.STAGED) == []


def test_tasks_that_sort_are_small_and_settings_return(spark, tmp_path, monkeypatch):
    source, folder = str(tmp_path / "files"), str(tmp_path / "inventory")
    rows = spark.range(0, 20_000, 1, 1).selectExpr("'s' scan_id", "concat('/', id) path", "id * 7919 % 20000 size_bytes")
    rows.write.option("parquet.block.size", 4096).parquet(source)
    monkeypatch.setattr(tables, "SORTED_BYTES", 8192)
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.maxConcurrentOutputFileWriters"]
    before = [spark.conf.get(n, None) for n in names]
    tables.write_inventory(spark.read.parquet(source), folder)
    assert [spark.conf.get(n, None) for n in names] == before
    stored = tables.read_inventory(spark, folder)
    assert stored.count() == 20_000 and len(stored.inputFiles()) > 8


def test_recommendations_are_made_once(spark, monkeypatch):
    calls = []

    def made(spark, sf):
        calls.append(sf)
        return spark.createDataFrame([("s", "low", 3), ("s", "high", 4)], "scan_id string, priority string, recoverable_bytes bigint")

    monkeypatch.setattr(queries, "_recs", made)
    got = {(r["priority"], r["recommendation_count"], r["recoverable_bytes"]) for r in queries.rec_replace(spark, "none").collect()}
    assert got == {("low", 1, 3), ("high", 1, 4)} and len(calls) == 1
