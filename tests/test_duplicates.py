import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from stowage.functions import hashing
from stowage.operators import duplicates, skew
from stowage.sources import buckets, listing

DDL = ("scan_id string, file_id string, path string, extension string, size_bytes bigint, "
       "content binary, modified_at timestamp")


def _content(frame, blobs):
    rows = [("s", f"f{i:03d}", f"/d/{i}.bin", ".bin", len(b), bytearray(b), None)
            for i, b in enumerate(blobs)]
    return frame(rows, DDL)


def _noise(n, seed):
    return random.Random(seed).randbytes(n)


BLOBS = [
    _noise(5000, 1), _noise(5000, 1), _noise(5000, 2),              # a pair and a same-size file
    _noise(1023, 3), _noise(1023, 3),                               # below the floor
    _noise(1024, 4), _noise(1024, 4), _noise(1024, 4),              # three at the floor
    b"a" * 4096 + b"1" * 100 + b"z" * 4096,
    b"a" * 4096 + b"2" * 100 + b"z" * 4096,                          # same ends, other middle
    b"", b"",
]


def test_partial_hash_bands(evaluate):
    sizes = [0, 100, 4096, 4097, 8192, 8193, 20000]
    blobs = [_noise(n, n) for n in sizes]
    got = evaluate([(bytearray(b), len(b)) for b in blobs], "c binary, n bigint",
                   lambda F: hashing.partial_hash(F.col("c"), F.col("n")))
    want = [hashlib.sha256(b if len(b) <= 8192 else b[:4096] + b[-4096:]).hexdigest()
            for b in blobs]
    assert got == want


def test_funnel_and_groups(frame):
    content = _content(frame, BLOBS)
    assert {r["size_bytes"]: r["file_count"] for r in
            duplicates.size_groups(content).collect()} == {5000: 3, 1024: 3, 8292: 2}
    twice = content.unionByName(content.withColumn("scan_id", F.lit("t")).where("file_id in ('f000', 'f007')"))
    assert duplicates.same_size_files(twice).count() == 8
    assert duplicates.partial_hash_candidates(twice).count() == 7
    assert duplicates.same_size_files(content).count() == 8
    # Equal ends pass the partial digest, and only the full one tells them apart.
    assert duplicates.partial_hash_candidates(content).count() == 7
    assert duplicates.full_hashes(content).count() == len(BLOBS)
    hashed = duplicates.full_hashes(content, 1024)
    groups = duplicates.duplicate_groups(hashed).collect()
    assert sorted((g["file_size_bytes"], g["member_count"], g["wasted_bytes"]) for g in groups) == [
        (1024, 3, 2048), (5000, 2, 5000)]
    members = duplicates.duplicate_members(hashed)
    assert members.count() == 5
    flags = {r["file_id"]: r["is_duplicate"] for r in duplicates.duplicate_flags(hashed).collect()}
    assert sum(flags.values()) == 5 and flags["f002"] is False
    checked = duplicates.verify_bytes(content, hashed).collect()
    assert len(checked) == 3 and all(r["identical"] for r in checked)


def test_no_duplicates(frame):
    hashed = duplicates.full_hashes(_content(frame, [_noise(2000, i) for i in range(4)]))
    assert duplicates.duplicate_groups(hashed).count() == 0
    assert duplicates.duplicate_summary(duplicates.duplicate_groups(hashed)).first() == (0, 0, 0)


DECISIONS = "scan_id string, group_id string, keep_file_id string, decided_at bigint"


@pytest.mark.parametrize("keep,gone,gone_too", [
    (None, {"f006", "f007"}, {"f006", "f007"}),
    ("f005", {"f006", "f007"}, {"f006", "f007"}),
    ("f006", {"f005", "f007"}, {"f007"}),
])
def test_removable_spares_one(frame, keep, gone, gone_too):
    hashed = duplicates.full_hashes(_content(frame, BLOBS)).where("size_bytes = 1024")
    group = hashed.first()["sha256"]
    decisions = frame([("s", group, "f007", 1), ("s", group, keep, 2)] if keep else [], DECISIONS)
    got = {r["file_id"] for r in duplicates.removable_files(hashed, decisions).collect()}
    assert got == gone
    strict = duplicates.removable_files(hashed, decisions, spare_first_too=True).collect()
    assert {r["file_id"] for r in strict} == gone_too
    resolved = duplicates.resolve_groups(duplicates.duplicate_members(hashed), decisions)
    assert {r["file_id"] for r in resolved.where("is_keeper").collect()} == ({keep} if keep else set())


def test_groups_of_two_scans_stay_apart(frame):
    rows = [("s1", "a"), ("s1", "b"), ("s2", "b"), ("s2", "c"), ("s3", "b")]
    hashed = frame([(s, f, f"/{f}", 5000, "h") for s, f in rows],
                   "scan_id string, file_id string, path string, size_bytes bigint, sha256 string")
    members = duplicates.duplicate_members(hashed)
    assert members.count() == 4
    decisions = frame([("s1", "h", "b", 1)], DECISIONS)
    gone = {(r["scan_id"], r["file_id"]) for r in duplicates.removable_files(hashed, decisions).collect()}
    assert gone == {("s1", "a"), ("s2", "c")}
    resolved = duplicates.resolve_groups(members, decisions)
    assert {(r["scan_id"], r["status"]) for r in resolved.collect()} == {("s1", "resolved"), ("s2", "unresolved")}
    assert {(r["scan_id"], r["files_removable"]) for r in duplicates.resolve_report(resolved).collect()} == {("s1", 1)}
    content = hashed.withColumn("content", F.encode(F.lit("x"), "utf-8"))
    checked = duplicates.verify_bytes(content, hashed).collect()
    assert {(r["scan_id"], r["file_id"]) for r in checked} == {("s1", "b"), ("s2", "c")}


def test_unknown_decision_changes_nothing(frame):
    hashed = duplicates.full_hashes(_content(frame, BLOBS), 1024)
    members = duplicates.duplicate_members(hashed)
    group = members.first()["group_id"]
    decisions = frame([("s", group, "nobody", 1)], DECISIONS)
    resolved = duplicates.resolve_groups(members, decisions)
    assert resolved.where("status = 'resolved'").count() == 0
    assert duplicates.unknown_decisions(members, decisions).count() == 1


def test_hot_key_is_split_and_whole(frame, spark):
    """A third of all rows share one key; nothing is lost and no piece has them all."""
    rows = spark.range(9000).select(
        F.when(F.col("id") < 3000, F.lit("hot")).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 2000).cast("string"))).alias("key"),
        F.col("id").cast("string").alias("file_id"),
    )
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    plain = rows.join(counts, "key")
    split = skew.join_by_key(rows, counts, "key", "n", "file_id", rows_per_task=100)
    assert split.exceptAll(plain.select(*split.columns)).count() == 0
    assert split.count() == plain.count()
    left = skew.join_by_key(rows, counts, "key", "n", "file_id", "left", rows_per_task=100)
    assert left.count() == 9000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        big = skew.join_by_key(rows, counts, "key", "n", "file_id", rows_per_task=100)
        sizes = big.where("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 1500


def test_real_files(spark, tmp_path):
    names = {"a/one.bin": BLOBS[0], "b/two.bin": BLOBS[0], "c/three.bin": BLOBS[2],
             "x/e1": BLOBS[8], "x/e2": BLOBS[9], "s/1": b"x" * 10, "s/2": b"x" * 10}
    for name, blob in names.items():
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(blob)
    listed = listing.list_files(spark, str(tmp_path), "s")
    hashed = duplicates.hash_listed_files(listed)
    groups = duplicates.duplicate_groups(hashed).collect()
    assert len(groups) == 1 and groups[0]["group_id"] == hashlib.sha256(BLOBS[0]).hexdigest()


def test_missing_files_have_no_digest_and_failures_are_raised(frame, tmp_path):
    (tmp_path / "here").write_bytes(b"y" * 5000)
    ddl = "scan_id string, file_id string, path string, size_bytes bigint"
    rows = [("s", "1", str(tmp_path / "here"), 5000), ("s", "2", str(tmp_path / "gone"), 5000)]
    files = frame(rows, ddl)
    got = {r["file_id"]: r["h"] for r in hashing.hash_files(files, "h").collect()}
    assert got == {"1": hashlib.sha256(b"y" * 5000).hexdigest(), "2": None}
    capped = hashing.hash_files(files, "h", max_bytes=4999).collect()
    assert all(r["h"] is None for r in capped)
    folder = frame([("s", "1", str(tmp_path), 5000)], ddl)
    with pytest.raises(Exception, match="director"):
        hashing.hash_files(folder, "h").collect()


def test_hardlinks(frame):
    rows = [(1, 7, "/b", "2", 5), (1, 7, "/a", "1", 5), (2, 7, "/c", "3", 5),
            (None, None, "/d", "4", 5), (None, None, "/e", "5", 5), (1, None, "/f", "6", 5)]
    df = frame(rows, "device int, inode int, path string, file_id string, size_bytes bigint")
    got = {(r["path"], r["link_count"]) for r in duplicates.collapse_hardlinks(df).collect()}
    assert got == {("/a", 2), ("/c", 1), ("/d", 1), ("/e", 1), ("/f", 1)}


def test_incremental_hashes_only_changes(frame):
    before = _content(frame, BLOBS)
    known = duplicates.full_hashes(before, min_bytes=0).withColumn(
        "modified_at", F.lit("2026-01-01").cast("timestamp")).withColumn("sha256", F.lit("known"))
    after = before.withColumn("modified_at", F.when(F.col("file_id") != "f000",
                              F.lit("2026-01-01").cast("timestamp"))
                              .otherwise(F.lit("2026-02-01").cast("timestamp")))
    twice = known.unionByName(known.withColumn("scan_id", F.lit("older")))
    rows = duplicates.incremental_hashes(after, twice).collect()
    got = {r["file_id"]: r["sha256"] for r in rows}
    assert len(got) == len(rows) == len(BLOBS)
    assert got["f000"] == hashlib.sha256(BLOBS[0]).hexdigest()
    assert all(v == "known" for k, v in got.items() if k != "f000")


def test_changed_files_are_hashed_above_the_join_and_nothing_is_shuffled(spark, frame, tmp_path):
    content = _content(frame, BLOBS).withColumn("modified_at", F.lit("2026-01-01").cast("timestamp"))
    known = buckets.write_buckets(duplicates.full_hashes(content), f"{tmp_path}/known", duplicates.STATE, 4)
    changed = content.withColumn("modified_at", F.when(F.col("file_id") < "f003", F.lit("2026-02-01").cast("timestamp"))
                                 .otherwise(F.col("modified_at")))
    found = buckets.write_buckets(changed, f"{tmp_path}/found", duplicates.STATE, 4)
    hashed = duplicates.incremental_hashes(found, known)
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("sha2(") == 1
    lines = plan.splitlines()
    digest = next(i for i, line in enumerate(lines) if "sha2(" in line)
    anti = next(i for i, line in enumerate(lines) if "LeftAnti" in line)
    assert digest < anti  # the digest is taken of what the join lets through
    got = {r["file_id"]: r["sha256"] for r in hashed.collect()}
    assert got == {f"f{i:03d}": hashlib.sha256(b).hexdigest() for i, b in enumerate(BLOBS)}
    # Another session finds the buckets by their folder.
    spark.sql(f"DROP TABLE {buckets._name(f'{tmp_path}/known')}")
    again = buckets.read_buckets(spark, f"{tmp_path}/known", known.schema, duplicates.STATE, 4)
    plan = duplicates.incremental_hashes(found, again)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_unchanged_real_files_are_not_opened(frame, tmp_path):
    path = tmp_path / "new"
    path.write_bytes(b"fresh")
    ddl = "file_id string, path string, size_bytes bigint, modified_at string"
    listed = frame([("a", str(path), 5, "2"), ("b", str(tmp_path / "gone"), 3, "1")], ddl)
    known = frame([(str(path), 5, "1", "old"), (str(tmp_path / "gone"), 3, "1", "kept")],
                  "path string, size_bytes bigint, modified_at string, sha256 string")
    got = {r["file_id"]: r["sha256"] for r in duplicates.incremental_listing_hashes(listed, known).collect()}
    assert got == {"a": hashlib.sha256(b"fresh").hexdigest(), "b": "kept"}


def test_bytes_pass_one_shuffle_and_pieces_agree(frame):
    blobs = [b"x" * 500] * 9 + [b"y" * 500] * 2 + [b"z", None]
    content = frame([("s", f"f{i:02d}", f"/{i}", ".b", len(b or b""), bytearray(b) if b else None, None)
                     for i, b in enumerate(blobs)], DDL)
    hashed = content.select("scan_id", "file_id", "size_bytes", F.when(
        F.col("file_id") < "f11", F.lit("g")).otherwise(F.lit("h")).alias("sha256"))
    for limit in (1 << 30, 1000):
        checked = duplicates.verify_bytes(content, hashed, limit)
        got = {r["file_id"]: (r["first_file_id"], r["identical"]) for r in checked.collect()}
        assert got == {**{f"f{i:02d}": ("f00", i < 9) for i in range(1, 11)}, "f12": ("f11", False)}
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not [
        line for line in plan.splitlines() if "Join" in line and "content" in line]


def test_ranges_of_real_files(spark, frame, tmp_path):
    whole = _noise(10_000, 1)
    other = whole[:9000] + b"!" + whole[9001:]
    rows = []
    for i, data in enumerate([whole, whole, other, whole[:-1], whole + b"1", None, b"", b""]):
        if data is not None:
            (tmp_path / str(i)).write_bytes(data)
        group = "e" if data == b"" else "g"
        size = {None: 10_000}.get(data, len(data or b""))
        rows.append(("s", group, f"f{i}", str(tmp_path / str(i)), 10_000 if i == 4 else size))
    members = frame(rows, "scan_id string, group_id string, file_id string, path string, size_bytes bigint")
    for piece in (1 << 20, 1024):
        got = {r["file_id"]: r["identical"] for r in duplicates.verify_files(members, piece).collect()}
        assert got == {"f1": True, "f2": False, "f3": False, "f4": False, "f5": False, "f7": True}


def test_resolved_members_and_totals_in_one_pass(frame):
    blobs = [*BLOBS, _noise(5000, 1)]
    content = _content(frame, blobs).withColumn(
        "extension", F.when(F.col("file_id") == "f006", None).when(F.col("file_id") > "f006", ".x").otherwise(".bin"))
    hashed = duplicates.full_hashes(content, 1024)
    members = duplicates.duplicate_members(hashed)
    ids = {r["group_id"]: r["file_id"] for r in members.orderBy("file_id").collect()}
    decisions = frame([("s", g, f, 1) for g, f in list(ids.items())[:1]] + [("s", "none", "f000", 2)], DECISIONS)
    columns = ["scan_id", "group_id", "file_id", "path", "file_size_bytes", "member_count", "wasted_bytes", "status",
               "is_keeper", "size_bytes", "extension"]
    old = duplicates.resolve_groups(members, decisions).select(*columns)
    new = duplicates.resolved_members(hashed, decisions).select(*columns)
    assert sorted(map(str, new.collect())) == sorted(map(str, old.collect()))
    plan = duplicates.resolved_members(hashed, decisions)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") <= 9
    row = duplicates.duplicate_totals(hashed).first()
    assert (row["duplicate_groups"], row["duplicate_files"], row["wasted_bytes"]) == duplicates.duplicate_summary(
        duplicates.duplicate_groups(hashed)).first()
    top = [r["extension"] for r in duplicates.top_duplicate_extensions(members, 5).collect()]
    assert row["top_extensions"] == top == [".bin", ".x"]
    assert duplicates.duplicate_totals(hashed.limit(0)).collect() == []
