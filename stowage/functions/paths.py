"""Path expressions. All but the Unicode form stay inside generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stowage.fixed_values import CATEGORY_EXTENSIONS
from stowage.functions.once import computed_once


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_path(path: Column) -> Column:
    """Forward slashes, and NFC for paths outside ASCII.

    Only those paths are sent to Python: the others go over as NULL, which
    costs a bit in a validity map and no text.
    """
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    outside_ascii = slashed.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfc(F.when(outside_ascii, slashed)), slashed)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_of(path: Column) -> Column:
    """The folder of a file; a file right below the root lies in ``/``."""
    head = F.left(path, F.length(path) - F.length(file_name(path)) - 1)
    return F.when(F.instr(path, "/") == 0, F.lit("")).when(head == "", "/").otherwise(head)


def suffix_of(name: Column) -> Column:
    """Lower-case suffix with its dot, NULL if there is none.

    The last dot counts, unless it is the first or the last character.
    """
    tail = F.substring_index(name, ".", -1)
    dot_at = F.length(name) - F.length(tail)
    return F.when((dot_at > 1) & (tail != ""), F.concat(F.lit("."), F.lower(tail)))


def sql_list(values: list[str]) -> str:
    """Constants as SQL text, which builds a long list in one call."""
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def category_of(extension: str = "extension", lists: dict[str, list[str]] | None = None) -> Column:
    """Content category of the named column; unknown and NULL are ``other``.

    The lists are constants, so each test is a hash-set lookup without a join.
    """
    arms = " ".join(
        f"WHEN lower({extension}) IN ({sql_list(members)}) THEN '{name}'"
        for name, members in (lists or CATEGORY_EXTENSIONS).items()
    )
    return F.expr(f"CASE {arms} ELSE 'other' END")


def with_path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds directory, filename, extension and category."""
    rows = computed_once(df, **{path: F.col(path), "filename": file_name(F.col(path))})
    rows = computed_once(rows, extension=suffix_of(F.col("filename")))
    return rows.withColumn("directory", directory_of(F.col(path))).withColumn(
        "category", category_of("extension")
    )


def components(path: Column) -> Column:
    return F.split(path, "/")


def depth_below(directory: Column, root: str) -> Column:
    """Levels from ``root`` down to ``directory``; the root itself is 0."""
    slashes = F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit("")))
    own = F.when(directory == "/", 0).otherwise(slashes)
    top = 0 if root == "/" else root.rstrip("/").count("/")
    return (own - F.lit(top)).cast("int")


def ancestors(directory: Column) -> Column:
    """All folders from ``/`` down to the directory itself, in that order."""
    depth = F.when(directory == "/", 0).otherwise(
        F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit("")))
    )
    return F.transform(
        F.sequence(F.lit(0), depth.cast("int")),
        lambda i: F.when(i == 0, "/").otherwise(
            F.call_function("substring_index", directory, F.lit("/"), i + 1)
        ),
    )


def under_root(folder: Column, root: str) -> Column:
    """Whether a folder is the root or lies below it."""
    if root == "/":
        return F.lit(True)
    root = root.rstrip("/")
    return (folder == root) | folder.startswith(root + "/")
