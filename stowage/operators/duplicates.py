"""Duplicate files: a funnel of size, partial digest and full digest.

Row tables carry ``scan_id, file_id, path, extension, size_bytes`` and, once
hashed, ``sha256``. A group is the files of one scan that share a digest: its
key is (scan_id, group_id), the digest being the group's id, so a second run
gives the same groups. Groups are never collected: every result is flat, with
one row per group or per member.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stowage.fixed_values import MIN_DUPLICATE_BYTES, PARTIAL_BYTES
from stowage.functions.hashing import compare_ranges, content_hash, hash_files, partial_hash
from stowage.operators.paging import where_all
from stowage.operators.skew import join_by_key
from stowage.session import shared_folder

GROUP = ["scan_id", "group_id"]
PARTIAL = ["scan_id", "size_bytes", "partial_hash"]
#: What tells that a file is as it was, and the buckets in which digests and content are stored.
STATE = ["path", "size_bytes", "modified_at"]


def size_groups(files: DataFrame, min_bytes: int = MIN_DUPLICATE_BYTES) -> DataFrame:
    """Sizes from ``min_bytes`` on that occur more than once in a scan."""
    return (
        files.where(F.col("size_bytes") >= min_bytes)
        .groupBy("scan_id", "size_bytes")
        .agg(F.count(F.lit(1)).alias("file_count"))
        .where(F.col("file_count") > 1)
    )


def same_size_files(files: DataFrame, min_bytes: int = MIN_DUPLICATE_BYTES) -> DataFrame:
    """Files that share their size with another file of their scan."""
    groups = size_groups(files, min_bytes).withColumnRenamed("file_count", "_n")
    return join_by_key(files, groups, ["scan_id", "size_bytes"], "_n", "file_id").drop("_n")


def _keep_repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur at least twice; rows with a NULL key drop out."""
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return join_by_key(rows, counts, keys, "_n", "file_id").drop("_n")


def partial_hashes(content: DataFrame, min_bytes: int = MIN_DUPLICATE_BYTES) -> DataFrame:
    """Partial digest of each file of a table with bytes, as a narrow table.

    The digest is taken where the row is read, so bytes are not shuffled.
    """
    return content.where(F.col("size_bytes") >= min_bytes).select(
        "scan_id", "file_id", "path", "extension", "size_bytes",
        partial_hash(F.col("content"), F.col("size_bytes")).alias("partial_hash"),
    )


def partial_hash_candidates(
    content: DataFrame, min_bytes: int = MIN_DUPLICATE_BYTES
) -> DataFrame:
    """Files that share size and partial digest with another file of their scan."""
    return _keep_repeated(partial_hashes(content, min_bytes), PARTIAL)


def full_hashes(
    content: DataFrame,
    min_bytes: int = 0,
    max_bytes: int | None = None,
) -> DataFrame:
    """Full digest of each file from a table with bytes, as a narrow table.

    Every size is hashed unless limits are given; the least size of a duplicate
    is the first stage's rule.

    A columnar table hands over the bytes of a row group whichever of its rows
    survive the funnel, so the digest is taken in that one pass; sending bytes
    through a join to save digests would cost far more.
    """
    rows = content.where(F.col("size_bytes") >= min_bytes)
    if max_bytes is not None:
        rows = rows.where(F.col("size_bytes") <= max_bytes)
    return rows.select(
        "scan_id", "file_id", "path", "extension", "size_bytes", "modified_at",
        content_hash(F.col("content")).alias("sha256"),
    )


def hash_listed_files(
    listing: DataFrame,
    min_bytes: int = MIN_DUPLICATE_BYTES,
    partitions: int | None = None,
    work_folder: str | None = None,
) -> DataFrame:
    """Full digests of real files, reading as few bytes as the funnel allows.

    Paths and sizes are all that moves. Before each hashing step the candidates
    are dealt out again, since a join leaves them grouped by key. Each step
    writes its digests to a table in the shared folder, so that no file is
    read twice for one step and a lost executor repeats only its own tasks.
    """
    spark = listing.sparkSession
    folder = work_folder or f"{shared_folder(spark)}/hashes-{uuid.uuid4().hex}"

    def hashed(df: DataFrame, name: str, edge: int | None = None) -> DataFrame:
        key = F.xxhash64("file_id")
        dealt = df.repartition(partitions, key) if partitions else df.repartition(key)
        hash_files(dealt, name, edge).write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    first = hashed(same_size_files(listing, min_bytes), "partial_hash", PARTIAL_BYTES)
    survivors = _keep_repeated(first, PARTIAL).drop("partial_hash")
    return hashed(survivors, "sha256").where(F.col("sha256").isNotNull())


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    """One row per content that occurs at least twice."""
    return (
        hashed.where(F.col("sha256").isNotNull())
        .groupBy("scan_id", "sha256")
        .agg(
            F.min("size_bytes").alias("file_size_bytes"),
            F.count(F.lit(1)).alias("member_count"),
        )
        .where(F.col("member_count") > 1)
        .withColumn("wasted_bytes", F.col("file_size_bytes") * (F.col("member_count") - 1))
        .withColumn("status", F.lit("unresolved"))
        .withColumnRenamed("sha256", "group_id")
    )


def _with_group(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Joins rows carrying ``group_id`` with their group, hot groups being split."""
    return join_by_key(rows, groups, GROUP, "member_count", "file_id", how)


def duplicate_members(hashed: DataFrame) -> DataFrame:
    """One row per file of a group, with the group's size and count."""
    rows = hashed.where(F.col("sha256").isNotNull()).withColumnRenamed("sha256", "group_id")
    return _with_group(rows, duplicate_groups(hashed)).withColumn("is_keeper", F.lit(False))


def duplicate_flags(hashed: DataFrame) -> DataFrame:
    """Every hashed file with a flag telling whether it has a copy."""
    rows = hashed.withColumnRenamed("sha256", "group_id")
    joined = _with_group(rows, duplicate_groups(hashed), "left")
    return joined.select(
        "scan_id", "file_id", "path", "size_bytes",
        F.col("member_count").isNotNull().alias("is_duplicate"),
    )


def duplicate_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.coalesce(F.sum("member_count"), F.lit(0)).alias("total_duplicate_files"),
        F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("total_wasted_bytes"),
    )


def top_duplicate_extensions(members: DataFrame, limit: int = 10) -> DataFrame:
    return (
        members.where(F.col("extension").isNotNull())
        .groupBy("extension")
        .agg(F.count(F.lit(1)).alias("file_count"))
        .orderBy(F.col("file_count").desc(), "extension")
        .limit(limit)
    )


def filter_groups(
    groups: DataFrame, min_wasted: int | None = None, status: str | None = None
) -> DataFrame:
    return where_all(
        groups,
        [
            None if min_wasted is None else F.col("wasted_bytes") >= min_wasted,
            None if status is None else F.col("status") == status,
        ],
    )


def group_order() -> list[Column]:
    return [F.col("wasted_bytes").desc(), F.col("group_id"), F.col("scan_id")]


def group_detail(members: DataFrame, group_ids: DataFrame | None = None) -> DataFrame:
    """Group columns beside each member; optionally for given groups only.

    Flat rows instead of a nested list, since a group may be of any size.
    """
    rows = members
    if group_ids is not None:
        rows = rows.join(group_ids.select(*GROUP).distinct(), GROUP, "left_semi")
    return rows.select(
        *GROUP, "file_size_bytes", "member_count", "wasted_bytes", "status",
        "file_id", "path", "is_keeper",
    )


def resolve_groups(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Marks the chosen keeper of each decided group.

    ``decisions`` has (scan_id, group_id, keep_file_id); the last one per group
    counts, by ``decided_at``. A decision naming a file outside the group
    changes nothing; ``unknown_decisions`` lists those.
    """
    chosen = _latest_decisions(decisions)
    valid = (
        members.select(*GROUP, F.col("file_id").alias("keep_file_id"), "member_count")
        .join(chosen, [*GROUP, "keep_file_id"])
        .groupBy(*GROUP)
        .agg(F.min("keep_file_id").alias("keep_file_id"), F.max("member_count").alias("_n"))
    )
    rows = members.drop("status", "is_keeper")
    joined = join_by_key(rows, valid, GROUP, "_n", "file_id", "left").drop("_n")
    return joined.withColumn(
        "is_keeper", F.coalesce(F.col("file_id") == F.col("keep_file_id"), F.lit(False))
    ).withColumn(
        "status", F.when(F.col("keep_file_id").isNotNull(), "resolved").otherwise("unresolved")
    ).drop("keep_file_id")


def resolved_members(hashed: DataFrame, decisions: DataFrame) -> DataFrame:
    """What ``resolve_groups`` gives, straight from the digests.

    The decisions are joined with the narrow rows first, so that one aggregate
    per group knows its size and its keeper, and one join brings both back.
    """
    rows = hashed.where(F.col("sha256").isNotNull()).withColumnRenamed("sha256", "group_id")
    chosen = _latest_decisions(decisions).select(
        *GROUP, F.col("keep_file_id").alias("file_id"), F.lit(True).alias("_chosen")
    )
    keeper = F.min(F.when(F.col("_chosen"), F.col("file_id")))
    groups = rows.select(*GROUP, "file_id", "size_bytes").join(chosen, [*GROUP, "file_id"], "left").groupBy(
        *GROUP).agg(
        F.min("size_bytes").alias("file_size_bytes"), F.count(F.lit(1)).alias("member_count"),
        keeper.alias("_keeper"),
    ).where("member_count > 1").withColumns({
        "wasted_bytes": F.col("file_size_bytes") * (F.col("member_count") - 1),
        "status": F.when(F.col("_keeper").isNotNull(), "resolved").otherwise("unresolved"),
    })
    joined = join_by_key(rows, groups, GROUP, "member_count", "file_id")
    return joined.withColumn(
        "is_keeper", F.coalesce(F.col("file_id") == F.col("_keeper"), F.lit(False))
    ).drop("_keeper")


def duplicate_totals(hashed: DataFrame, top: int = 5) -> DataFrame:
    """Groups, files, wasted bytes and the most frequent extensions of each scan, in one pass.

    Files are counted per digest and extension first; a digest's window then
    holds a row for each of its extensions, and a scan's last step one for each
    extension of it.
    """
    counted = hashed.where(F.col("sha256").isNotNull()).groupBy("scan_id", "sha256", "extension").agg(
        F.count(F.lit(1)).alias("n"), F.min("size_bytes").alias("size"))
    whole = W.partitionBy("scan_id", "sha256")
    placed = counted.select(
        "scan_id", "extension", "n", F.sum("n").over(whole).alias("members"), F.min("size").over(whole).alias("size"),
        F.row_number().over(whole.orderBy("extension")).alias("at"),
    ).where("members > 1")
    first = F.col("at") == 1
    by_extension = placed.groupBy("scan_id", "extension").agg(
        F.sum("n").alias("n"), F.count_if(first).alias("groups"),
        F.sum(F.when(first, F.col("size") * (F.col("members") - 1)).otherwise(0)).alias("wasted"))
    rank = F.row_number().over(W.partitionBy("scan_id").orderBy(
        F.col("extension").isNull(), F.col("n").desc(), "extension"))
    listed = F.when((F.col("rank") <= top) & F.col("extension").isNotNull(), F.struct("rank", "extension"))
    return by_extension.withColumn("rank", rank).groupBy("scan_id").agg(
        F.sum("groups").alias("duplicate_groups"), F.sum("n").alias("duplicate_files"),
        F.sum("wasted").alias("wasted_bytes"),
        F.transform(F.array_sort(F.collect_list(listed)), lambda e: e["extension"]).alias("top_extensions"))


def _latest_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(*GROUP).agg(
        F.max(F.struct("decided_at", "keep_file_id"))["keep_file_id"].alias("keep_file_id")
    )


def unknown_decisions(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions whose file is not a member of the group."""
    known = members.select(*GROUP, F.col("file_id").alias("keep_file_id"))
    return _latest_decisions(decisions).join(known, [*GROUP, "keep_file_id"], "left_anti")


def resolve_report(resolved: DataFrame) -> DataFrame:
    """Files and bytes that each resolved group gives back."""
    return (
        resolved.where(F.col("status") == "resolved")
        .groupBy(*GROUP)
        .agg(
            F.max("member_count").alias("member_count"),
            (F.max("member_count") - 1).alias("files_removable"),
            F.max("wasted_bytes").alias("bytes_recovered"),
            F.max(F.when(F.col("is_keeper"), F.col("file_id"))).alias("keeper_file_id"),
        )
    )


def auto_keepers(members: DataFrame, policy: str = "oldest") -> DataFrame:
    """The keeper of each group by policy: oldest, newest or largest."""
    first = {
        "oldest": F.min(F.struct("modified_at", "file_id")),
        "newest": F.max(F.struct("modified_at", "file_id")),
        "largest": F.max(F.struct("size_bytes", "file_id")),
    }[policy]
    return members.groupBy(*GROUP).agg(
        first["file_id"].alias("keep_file_id"), F.max("member_count").alias("member_count")
    )


def removable_files(
    hashed: DataFrame, decisions: DataFrame | None = None, spare_first_too: bool = False
) -> DataFrame:
    """Copies that may go: all but the group's keeper, or but the first by id.

    ``spare_first_too`` keeps the first member even where a keeper is chosen.
    ``decisions`` choose keepers as in ``resolve_groups``. One aggregate per
    group knows its size, first member and keeper, and one join brings it back,
    so the digests are read twice and a huge group is never sorted in one task.
    """
    rows = hashed.where(F.col("sha256").isNotNull()).select(
        "scan_id", F.col("sha256").alias("group_id"), "file_id", "path", "size_bytes"
    )
    marked = rows.select(*GROUP, "file_id")
    if decisions is None:
        keeper = F.lit(None).cast("string")
    else:
        chosen = _latest_decisions(decisions).select(
            *GROUP, F.col("keep_file_id").alias("file_id"), F.lit(True).alias("_chosen")
        )
        marked = marked.join(chosen, [*GROUP, "file_id"], "left")
        keeper = F.when(F.col("_chosen"), F.col("file_id"))
    groups = marked.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("_n"), F.min("file_id").alias("_first"), F.min(keeper).alias("_keeper")
    ).where("_n > 1")
    joined = join_by_key(rows, groups, GROUP, "_n", "file_id")
    gone = F.col("file_id") != F.coalesce("_keeper", "_first")
    if spare_first_too:
        gone &= F.col("file_id") != F.col("_first")
    return joined.where(gone).select(*GROUP, "file_id", "path", "size_bytes")


def removable_totals(removable: DataFrame) -> DataFrame:
    return removable.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )


def _verified(rows: DataFrame, identical: Column) -> DataFrame:
    return rows.select(
        *GROUP, "first_file_id", "file_id", F.coalesce(identical, F.lit(False)).alias("identical")
    )


def verify_bytes(content: DataFrame, hashed: DataFrame, bytes_per_task: int = 1 << 30) -> DataFrame:
    """Compares each copy byte for byte with the first member of its group.

    Digests are taken anew where the rows are read, so a file changed since it
    was hashed shows. Files of one digest meet in one shuffle, the only one that
    moves bytes, and each is compared with the first of them. Digests with more
    than ``bytes_per_task`` bytes are cut into pieces, and their first file is
    repeated once per piece. Files without bytes are not identical, and of files
    that differ in spite of one digest only those equal to the first one are.
    """
    file = ["scan_id", "file_id"]
    own = content.where("content is not null").select(
        *file, "content", content_hash(F.col("content")).alias("_digest")
    )
    heavy = own.groupBy("scan_id", "_digest").agg(
        F.sum(F.octet_length("content")).alias("_n"), F.min("file_id").alias("_first")
    ).where(F.col("_n") > bytes_per_task).select(
        "scan_id", "_digest", "_first", F.ceil(F.col("_n") / bytes_per_task).cast("int").alias("_pieces")
    )
    # At most one for each ``bytes_per_task`` bytes of all files.
    dealt = own.join(F.broadcast(heavy), ["scan_id", "_digest"], "left").withColumn("_piece", F.explode(
        F.when(F.col("_pieces").isNull(), F.array(F.lit(0)))
        .when(F.col("file_id") == F.col("_first"), F.sequence(F.lit(0), F.col("_pieces") - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("file_id"), F.col("_pieces")).cast("int")))))
    before = W.partitionBy("scan_id", "_digest", "_piece").orderBy("file_id").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    checked = dealt.withColumn("_same", F.col("content") == F.first("content").over(before)).groupBy(
        *file).agg(F.min("_digest").alias("_digest"), F.bool_and("_same").alias("_same"))

    members = hashed.where(F.col("sha256").isNotNull()).select(
        "scan_id", F.col("sha256").alias("group_id"), "file_id"
    )
    groups = members.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("_n"), F.min("file_id").alias("first_file_id")
    ).where("_n > 1")
    rows = join_by_key(members, groups, GROUP, "_n", "file_id").where("file_id <> first_file_id")
    firsts = checked.select(
        "scan_id", F.col("file_id").alias("first_file_id"), F.col("_digest").alias("_model"),
        F.col("_same").alias("_model_same"))
    models = groups.join(firsts, ["scan_id", "first_file_id"]).select(*GROUP, "_n", "_model", "_model_same")
    joined = join_by_key(
        rows.drop("_n").join(checked, file, "left"), models, GROUP, "_n", "file_id", "left")
    return _verified(joined, (F.col("_digest") == F.col("_model")) & F.col("_same") & F.col("_model_same"))


def verify_files(members: DataFrame, piece_bytes: int = 256 << 20) -> DataFrame:
    """Compares each real file of a group byte for byte with the first member.

    ``members`` has (scan_id, group_id, file_id, path, size_bytes). Files are
    cut into pieces of ``piece_bytes``, which are dealt out over all tasks,
    compared by ranged reads, and folded together; no bytes are shuffled.
    Files of other sizes differ without being read, and so do files that are gone.
    """
    first = F.min_by(F.struct("file_id", "path", "size_bytes"), "file_id")
    groups = members.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first")).where(
        "_n > 1").select(
        *GROUP, "_n", F.col("_first.file_id").alias("first_file_id"),
        F.col("_first.path").alias("first_path"), F.col("_first.size_bytes").alias("first_bytes"))
    plain = members.select(*GROUP, "file_id", "path", "size_bytes")
    rows = join_by_key(plain, groups, GROUP, "_n", "file_id").where("file_id <> first_file_id")
    alike = F.coalesce(F.col("size_bytes") == F.col("first_bytes"), F.lit(False))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size_bytes") - 1, F.lit(0)),
                        F.lit(piece_bytes).cast("bigint"))
    pieces = rows.where(alike).select(
        *GROUP, "first_file_id", "file_id", "first_path", "path", "size_bytes", F.explode(starts).alias("start"))
    dealt = pieces.repartition(F.xxhash64("scan_id", "file_id", "start"))
    compared = compare_ranges(dealt, "identical", piece_bytes)
    folded = compared.groupBy(*GROUP, "first_file_id", "file_id").agg(F.bool_and("identical").alias("_same"))
    other = rows.where(~alike).select(*GROUP, "first_file_id", "file_id", F.lit(False).alias("_same"))
    return _verified(folded.unionByName(other), F.col("_same"))


def collapse_hardlinks(listing: DataFrame) -> DataFrame:
    """One row per (device, inode): the path that sorts first.

    Files of which either is unknown are no links of each other and stay as they are.
    """
    rest = [c for c in listing.columns if c not in ("device", "inode", "path")]
    known = F.col("device").isNotNull() & F.col("inode").isNotNull()
    linked = (
        listing.where(known).groupBy("device", "inode")
        .agg(F.min(F.struct("path", *rest)).alias("_row"), F.count(F.lit(1)).alias("link_count"))
        .select("_row.*", "device", "inode", "link_count")
    )
    single = listing.where(~known).select(
        "path", *rest, "device", "inode", F.lit(1).cast("bigint").alias("link_count")
    )
    return linked.unionByName(single)


def incremental_hashes(content: DataFrame, known: DataFrame) -> DataFrame:
    """Digests of a new scan, taken anew only for files not known unchanged.

    ``known`` has (path, size_bytes, modified_at, sha256) of earlier scans; of
    several digests of one state of a file the largest counts, so a file gives
    one row. Bytes are hashed above the join that leaves the unchanged files
    out. With both tables stored in buckets of ``STATE`` (see ``write_buckets``)
    nothing is shuffled, neither bytes nor digests.
    """
    states = known.groupBy(*STATE).agg(F.max("sha256").alias("sha256"))
    columns = ["scan_id", "file_id", "path", "extension", "size_bytes", "modified_at", "sha256"]
    listed = content.select("scan_id", "file_id", "extension", *STATE)
    reused = listed.join(states.hint("shuffle_hash"), STATE).select(*columns)
    # The side with bytes is streamed past the digests, so it is never sorted.
    changed = content.join(states.select(*STATE).hint("shuffle_hash"), STATE, "left_anti")
    return reused.unionByName(full_hashes(changed).select(*columns))


def incremental_listing_hashes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """As ``incremental_hashes`` for real files: only files not known unchanged are opened.

    The changed ones are dealt out again, since a join leaves them grouped by key.
    """
    states = known.groupBy(*STATE).agg(F.max("sha256").alias("sha256"))
    found = listing.join(states, STATE, "left")
    changed = found.where("sha256 is null").drop("sha256").repartition(F.xxhash64("file_id"))
    return found.where("sha256 is not null").unionByName(hash_files(changed, "sha256"))
