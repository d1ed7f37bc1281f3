"""Changes of stored tables that break off at any step, and one store for batch and stream."""

import pytest
from pyspark.sql import functions as F

from stowage.sources import commits, tables
from stowage.streaming import jobs

DDL = "scan_id string, day string, v int"


def rows(spark, folder):
    return sorted((r["scan_id"], str(r["day"]), r["v"]) for r in spark.read.parquet(folder).collect())


def test_replaced_partitions(spark, frame, tmp_path):
    folder = f"{tmp_path}/t"
    tables.replace_partitions(frame([("a", "1", 1), ("a", "2", 2), ("b/ c", "1", 3)], DDL), folder, "scan_id", "day")
    tables.replace_partitions(frame([("a", "2", 9)], DDL), folder, "scan_id", "day")
    assert rows(spark, folder) == [("a", "1", 1), ("a", "2", 9), ("b/ c", "1", 3)]
    tables.replace_partitions(frame([("a", "3", 4)], DDL), folder, "scan_id", "day", replacing=["a", "b/ c", "none"])
    assert rows(spark, folder) == [("a", "3", 4)]
    none = frame([], DDL)
    tables.replace_partitions(none, folder, "scan_id", "day", replacing=["a"])
    assert tables.read_table(none, folder).count() == 0


def test_a_table_may_be_replaced_from_itself(spark, frame, tmp_path):
    folder = f"{tmp_path}/t"
    tables.replace_partitions(frame([("a", "1", 1), ("b", "1", 2)], DDL), folder, "scan_id")
    more = spark.read.parquet(folder).withColumn("v", F.col("v") + 10)
    tables.replace_partitions(more.where("scan_id = 'a'"), folder, "scan_id")
    assert rows(spark, folder) == [("a", "1", 11), ("b", "1", 2)]


def test_a_change_that_breaks_off_is_finished_or_forgotten(spark, frame, tmp_path, monkeypatch):
    """Whichever step of the move fails, the next writer or reader sees all of it."""
    before = [("a", "1", 1), ("a", "2", 2), ("b", "1", 3), ("c", "1", 4)]
    for broken in range(5):
        folder = f"{tmp_path}/t{broken}"
        tables.replace_partitions(frame(before, DDL), folder, "scan_id", "day")
        left = [broken]
        plain = {name: getattr(commits.Store, name) for name in ("move", "remove")}

        def step(name):
            def run(self, *args):
                if left[0] == 0:
                    raise OSError("broken off")
                left[0] -= 1
                return plain[name](self, *args)
            return run

        for name in plain:
            monkeypatch.setattr(commits.Store, name, step(name))
        with pytest.raises(OSError):
            tables.replace_partitions(
                frame([("a", "2", 8), ("b", "2", 9)], DDL), folder, "scan_id", "day", replacing=["a", "b"])
        monkeypatch.undo()
        commits.recover(spark, folder)
        after = [("a", "2", 8), ("b", "2", 9), ("c", "1", 4)]
        assert rows(spark, folder) == (before if broken < 2 else after)
        commits.discard(spark, folder)
        assert rows(spark, folder) == (before if broken < 2 else after)
        assert commits.Store(spark, folder).names(commits.STAGED) == []


def test_batch_and_stream_share_a_store(spark, frame, tmp_path):
    folder, source, state = (f"{tmp_path}/{n}" for n in ("store", "in", "state"))
    ddl = "scan_id string, path string, size_bytes bigint"
    tables.write_inventory(frame([("s", "/a", 1), ("s", "/b", 2), ("t", "/a", 3)], ddl), folder)
    frame([("s", "/b", 5), ("u", "/z", 6)], ddl).coalesce(1).write.parquet(source)
    stream = jobs.stream_table(spark, source)
    jobs.inventory_stream(stream, folder, state, once=True).awaitTermination()

    def now():
        return sorted((r["scan_id"], r["path"], r["size_bytes"]) for r in
                      tables.current_inventory(spark, folder).collect())

    want = [("s", "/a", 1), ("s", "/b", 5), ("t", "/a", 3), ("u", "/z", 6)]
    assert now() == want
    # The batch comes again, as after a crash between its write and the stream's own note of it.
    for _ in range(2):
        tables.add_arrivals(frame([("s", "/b", 5), ("u", "/z", 6)], ddl), folder, 0)
        assert now() == want
        assert tables.read_inventory(spark, folder).count() == 5
    tables.add_arrivals(frame([("s", "/b", 7)], ddl), folder, 1)
    assert now()[1] == ("s", "/b", 7)
    tables.write_inventory(frame([("s", "/c", 8)], ddl), folder)
    assert now() == [("s", "/c", 8), ("t", "/a", 3), ("u", "/z", 6)]
    assert tables.read_inventory(spark, folder, "u").count() == 1
