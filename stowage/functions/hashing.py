"""Content digests: expressions for byte columns, ranged reads for real files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stowage.fixed_values import PARTIAL_BYTES
from stowage.sources.stores import open_store

_CHUNK = 1 << 20


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes as lower-case hex."""
    return F.sha2(content, 256)


def partial_hash(content: Column, size: Column, edge: int = PARTIAL_BYTES) -> Column:
    """SHA-256 of the first and last ``edge`` bytes; of all bytes if there are no more."""
    ends = F.concat(F.substring(content, 1, edge), F.substring(content, -edge, edge))
    return F.sha2(F.when(size <= 2 * edge, content).otherwise(ends), 256)


def _digest(path: str, size: int, edge: int | None) -> str | None:
    """Digest of one file, read in pieces; NULL if there is no such file any more."""
    try:
        store, name = open_store(path)
        digest = hashlib.sha256()
        with store.open_input_file(name) as source:
            if edge is not None and size > 2 * edge:
                digest.update(source.read_at(edge, 0))
                digest.update(source.read_at(edge, size - edge))
            else:
                while piece := source.read(_CHUNK):
                    digest.update(piece)
        return digest.hexdigest()
    except FileNotFoundError:
        return None


def hash_files(
    files: DataFrame, output: str, edge: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Adds the digest of the file at ``path`` to each row.

    Only paths and sizes are shuffled, never bytes. ``edge`` asks for the
    partial digest. A file that is gone gets NULL; any other failure to read
    fails the task, so that Spark tries it again and nothing counts as unique
    because a store was busy. With ``max_bytes`` larger files get NULL too,
    unless only their ends are read.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def wanted(size: int) -> bool:
        return edge is not None or max_bytes is None or size <= max_bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[output] = [
                _digest(path, size, edge) if wanted(size) else None
                for path, size in zip(batch["path"], batch["size_bytes"], strict=True)
            ]
            yield batch

    return files.mapInPandas(run, schema=f"{schema}, `{output}` string")


def _same_range(one: str, other: str, start: int, length: int) -> bool:
    """Whether two files have the same bytes in a range, read in pieces."""
    try:
        (store_a, a), (store_b, b) = open_store(one), open_store(other)
        with store_a.open_input_file(a) as left, store_b.open_input_file(b) as right:
            for at in range(start, start + length, _CHUNK):
                n = min(_CHUNK, start + length - at)
                piece = left.read_at(n, at)
                if len(piece) < n or piece != right.read_at(n, at):
                    return False
            return left.size() == right.size()
    except FileNotFoundError:
        return False


def compare_ranges(pieces: DataFrame, output: str, piece_bytes: int) -> DataFrame:
    """Whether ``path`` and ``first_path`` agree in the piece that begins at ``start``.

    A file that is gone or shorter differs; any other failure to read fails
    the task, so that Spark tries it again.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = (batch[c] for c in ("first_path", "path", "start", "size_bytes"))
            batch[output] = [
                _same_range(one, other, start, min(piece_bytes, size - start))
                for one, other, start, size in zip(*columns, strict=True)
            ]
            yield batch

    return pieces.mapInPandas(run, schema=f"{schema}, `{output}` boolean")
