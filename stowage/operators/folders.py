"""Folder tables from file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.paths import depth_below, directory_of, file_name, under_root


def _folder_columns(path: Column, root: str) -> list[Column]:
    parent = F.left(path, F.length(path) - F.length(file_name(path)) - 1)
    return [
        F.when(path == "/", "/").otherwise(file_name(path)).alias("name"),
        F.when(path != root, F.when(parent == "", "/").otherwise(parent)).alias("parent_path"),
        depth_below(path, root).alias("depth"),
    ]


def with_each_ancestor(df: DataFrame, folder: str, root: str = "/", name: str = "path") -> DataFrame:
    """One row per folder from the root down to ``folder``, itself included.

    Rows outside the root give none. A prefix of ``n`` components is the text
    before the slash number ``n + 1``, so no array of prefixes is built.
    """
    top = 0 if root == "/" else root.rstrip("/").count("/")
    path = F.col(folder)
    kept = [c for c in df.columns if c != name]
    level = F.explode(F.sequence(F.lit(top), depth_below(path, "/")))
    prefix = F.call_function("substring_index", F.col("_at"), F.lit("/"), F.col("_level") + 1)
    return (
        df.where(under_root(path, root))
        .select(*[c for c in kept], path.alias("_at"), level.alias("_level"))
        .withColumn(name, F.when(F.col("_level") == 0, "/").otherwise(prefix))
        .drop("_at", "_level")
    )


def folder_table(files: DataFrame, root: str = "/") -> DataFrame:
    """One row per folder at or below the root that holds a file at any depth."""
    directories = files.select("scan_id", "directory").distinct()
    paths = with_each_ancestor(directories, "directory", root).select("scan_id", "path").distinct()
    return paths.select("scan_id", "path", *_folder_columns(F.col("path"), root))


def direct_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files lying directly in each folder."""
    return files.groupBy("scan_id", "directory").agg(
        F.sum("size_bytes").alias("total_size_bytes"), F.count(F.lit(1)).alias("file_count")
    )


def folder_rollup(files: DataFrame, root: str = "/") -> DataFrame:
    """Recursive bytes, files and folders of each folder.

    Files are first summed per directory; only these sums are repeated for the
    ancestors. All sums combine on the map side, so the root, which receives
    something from every directory, gets one row per task.
    """
    up = with_each_ancestor(direct_sizes(files), "directory", root)
    sums = up.groupBy("scan_id", "path").agg(
        F.sum("total_size_bytes").alias("total_size_bytes"), F.sum("file_count").alias("file_count")
    )
    # Each folder now counts once for every folder above it.
    lines = with_each_ancestor(sums.withColumnRenamed("path", "_own"), "_own", root)
    own = F.col("_own") == F.col("path")
    full = lines.groupBy("scan_id", "path").agg(
        F.sum(F.when(own, F.col("total_size_bytes")).otherwise(0)).alias("total_size_bytes"),
        F.sum(F.when(own, F.col("file_count")).otherwise(0)).alias("file_count"),
        F.sum(F.when(own, 0).otherwise(1)).cast("bigint").alias("dir_count"),
    )
    return full.select(
        "scan_id",
        "path",
        *_folder_columns(F.col("path"), root),
        "total_size_bytes",
        "file_count",
        "dir_count",
    )


def depth_limit(files: DataFrame, max_depth: int, root: str = "/") -> DataFrame:
    """Files whose folder is at most ``max_depth`` levels below the root."""
    return files.where(
        under_root(F.col("directory"), root)
        & (depth_below(F.col("directory"), root) <= max_depth)
    )


#: The columns of a maintained rollup; names and depths follow from the path.
ROLLUP = ["path", "total_size_bytes", "file_count", "dir_count"]


def rollup_changes(delta: DataFrame, root: str = "/") -> DataFrame:
    """Signed bytes and files per folder and all above it, from a delta of two inventories.

    A path occurs once in an inventory, since the delta matches files by path.
    """
    one = F.when(F.col("change") == "new", 1).when(F.col("change") == "gone", -1).otherwise(0)
    grown = F.coalesce("size_bytes", F.lit(0)) - F.coalesce("old_size_bytes", F.lit(0))
    sums = delta.where("change <> 'unchanged'").groupBy(directory_of(F.col("path")).alias("directory")).agg(
        F.sum(grown).alias("bytes"), F.sum(one).cast("bigint").alias("files"))
    return with_each_ancestor(sums, "directory", root).groupBy("path").agg(
        F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))


def apply_changes(stored: DataFrame, changes: DataFrame, root: str = "/") -> DataFrame:
    """The rollup after the changes: ``stored`` holds all folders that they touch, and maybe more.

    A folder is there while it holds a file at any depth; one that comes or goes
    counts for every folder above it.
    """
    zero = F.lit(0).cast("bigint")
    both = stored.join(changes, "path", "full_outer").select(
        "path", (F.coalesce("total_size_bytes", zero) + F.coalesce("bytes", zero)).alias("total_size_bytes"),
        (F.coalesce("file_count", zero) + F.coalesce("files", zero)).alias("file_count"),
        F.coalesce("dir_count", zero).alias("dir_count"),
        F.coalesce(F.col("file_count") > 0, F.lit(False)).cast("int").alias("_was"))
    born = (F.col("file_count") > 0).cast("int") - F.col("_was")
    turned = both.select(F.col("path").alias("_own"), born.alias("_born")).where("_born <> 0")
    dirs = with_each_ancestor(turned, "_own", root).where("path <> _own").groupBy("path").agg(
        F.sum("_born").alias("_dirs"))
    return both.where("file_count > 0").join(dirs, "path", "left").select(
        "path", "total_size_bytes", "file_count",
        (F.col("dir_count") + F.coalesce("_dirs", zero)).alias("dir_count"))


def with_folder_columns(rollup: DataFrame, root: str = "/") -> DataFrame:
    """A maintained rollup with the names, parents and depths that ``folder_rollup`` gives."""
    return rollup.select("path", *_folder_columns(F.col("path"), root), *ROLLUP[1:])
