"""Changes of a stored table that happen whole or not at all.

New files are written beside the table, in a folder that readers don't see. A
marker that names the change makes it final; then files are moved into place.
Whoever next changes or recovers the table finishes a marked change that was
broken off, and removes what was never marked, so a job that dies in between
leaves neither old and new rows together nor a hole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Names that begin with an underscore are no part of a table.
STAGED, MARKER = "_staged", "_commit"
#: Partitions that a task writes side by side; only rows of further ones are sorted by partition.
WRITERS = 8


class Store:
    """The file system of a table's folder, whatever it is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.path(*names))

    def names(self, *at: str) -> list[tuple[str, bool]]:
        """Names in a folder, and whether each is a folder."""
        if not self.exists(*at):
            return []
        return [(s.getPath().getName(), s.isDirectory()) for s in self.fs.listStatus(self.path(*at))]

    def leaves(self, *at: str) -> list[str]:
        """Folders of partitions that hold files, relative to ``at``."""
        found, inside = [], self.names(*at)
        for name, folder in inside:
            if folder and "=" in name:
                found += ["/".join([name, leaf] if leaf else [name]) for leaf in self.leaves(*at, name)]
        if any(not folder and name[0] not in "_." for name, folder in inside):
            found.append("")
        return found

    def remove(self, *names: str) -> None:
        self.fs.delete(self.path(*names), True)

    def write(self, text: str, *names: str) -> None:
        out = self.fs.create(self.path(*names), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, *names: str) -> str:
        size = self.fs.getFileStatus(self.path(*names)).getLen()
        data = self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(self.fs.open(self.path(*names)), size)
        return bytes(data).decode()

    def partition(self, key: str, value: str) -> str:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return escaped.getPartitionPathString(key, value)

    def move(self, source: list[str], target: list[str]) -> None:
        """Moves a file or folder in place of another; done already if there is none to move."""
        if self.exists(*source):
            self.remove(*target)
            self.fs.mkdirs(self.path(*target).getParent())
            if not self.fs.rename(self.path(*source), self.path(*target)):
                raise OSError(f"{'/'.join(source)} can't be moved to {'/'.join(target)}")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the queries that run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)


def stage(df: DataFrame, folder: str, keys: list[str]) -> tuple[Store, str]:
    """Writes rows, parted by the keys, where readers of the table don't see them."""
    store, change = Store(df.sparkSession, folder), uuid.uuid4().hex
    recover(df.sparkSession, folder)
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(WRITERS)):
        df.write.mode("overwrite").partitionBy(*keys).parquet(f"{folder}/{STAGED}/{change}/rows")
    return store, change


def _finish(store: Store, change: str) -> None:
    """Makes a marked change, or what is left of it to do."""
    at = [STAGED, change]
    todo = json.loads(store.read(*at, MARKER))
    for leaf in todo["gone"]:
        store.remove(leaf)
    for leaf in todo["replaced"]:
        store.move([*at, "rows", leaf], [leaf])
    for leaf, prefix in todo["added"].items():
        for name, _ in store.names(leaf):
            if name.startswith(prefix) and not name.startswith(f"{prefix}{change}"):
                store.remove(leaf, name)
        for name, _ in store.names(*at, "rows", leaf):
            store.move([*at, "rows", leaf, name], [leaf, f"{prefix}{change}-{name}"])
    store.remove(*at)


def recover(spark: SparkSession, folder: str) -> None:
    """Finishes marked changes that were broken off."""
    store = Store(spark, folder)
    for change, _ in store.names(STAGED):
        if store.exists(STAGED, change, MARKER):
            _finish(store, change)


def discard(spark: SparkSession, folder: str) -> None:
    """Removes what writers that died have left unmarked; call it when nobody writes."""
    recover(spark, folder)
    Store(spark, folder).remove(STAGED)


def _commit(store: Store, change: str, **todo) -> None:
    store.fs.mkdirs(store.path())
    text = json.dumps({"gone": [], "replaced": [], "added": {}} | todo)
    store.write(text, STAGED, change, f"{MARKER}-draft")
    store.move([STAGED, change, f"{MARKER}-draft"], [STAGED, change, MARKER])
    _finish(store, change)


def replace(store: Store, change: str, key: str, values: list[str]) -> None:
    """Staged partitions take the place of stored ones; of the values of ``key`` no others stay."""
    leaves = store.leaves(STAGED, change, "rows")
    old = [store.partition(key, v) for v in values]
    held = [f"{top}/{leaf}" if leaf else top for top in old for leaf in store.leaves(top)]
    _commit(store, change, replaced=leaves, gone=[leaf for leaf in held if leaf not in leaves])


def add(store: Store, change: str, delivery: str) -> None:
    """Staged files join their partitions, in place of those of an earlier delivery of that name."""
    leaves = store.leaves(STAGED, change, "rows")
    _commit(store, change, added={leaf: f"{delivery}." for leaf in leaves})
