"""Short runs of characters in many texts at once, found by their hashes.

A text is an array of code points; the hash of each run of ``n`` characters is
made from that of the run of ``n - 1`` at the same place, for all texts of a
batch together. Runs are looked up in a bitmap of slots, whose size is bounded
whatever the number of runs in it. A slot taken by another run makes a row
more, which the caller's join drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Lengths of runs.
LENGTHS = (3, 4, 6)
#: Texts that are hashed together: their arrays fit in a processor's cache.
TOGETHER = 500
#: Bits of a slot's number: of the counters, and at most of the bitmap that finds runs (8 MB).
COUNTER_BITS, MOST_BITS = 22, 26
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _points(column: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, their code points, and where each begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    _, ends, held = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = memoryview(held or b"")[ends[0]:ends[-1]]
    first = np.append((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80, True)
    starts = ends - ends[0]
    try:
        joined = str(whole, "utf-8")
        if not first[starts].all():
            raise ValueError("a text begins within a character")
        if not joined.isascii():
            starts = np.append(0, np.cumsum(first))[starts]
    except ValueError:
        texts = [b.decode("utf-8", "replace") for b in column.to_pylist()]
        joined = "".join(texts)
        starts = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64), starts


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.column(0).slice(at, TOGETHER)


def _hashes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the runs of each length, by the place where they begin."""
    hashed = points
    for n in range(2, LENGTHS[-1] + 1):
        hashed = hashed[:-1] * _BASE + points[n - 1:]
        if n in LENGTHS:
            yield n, hashed ^ (hashed >> np.uint64(29))


def _slot(hashed: np.ndarray, bits: int, number: int) -> np.ndarray:
    return ((hashed * _MIX[number]) >> np.uint64(64 - bits)).astype(np.int64)


def _held(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _found(points: np.ndarray, starts: np.ndarray, bitmap: np.ndarray, bits: int, hashes: int):
    """Length, first slots, places and rows of the runs that the bitmap holds."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for n, hashed in _hashes(points):
        slots = _slot(hashed, bits, 0)
        at = np.flatnonzero(_held(bitmap, slots))
        for number in range(1, hashes):
            at = at[_held(bitmap, _slot(hashed[at], bits, number))]
        row = rows[at]
        inside = at + n <= starts[row + 1]
        yield n, slots[at[inside]], at[inside], row[inside]


def with_slots(runs: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """Adds ``slots``, the slots of each run."""

    @F.pandas_udf("array<bigint>")
    def slots(texts: pd.Series) -> pd.Series:
        _, points, starts = _points(pa.array(texts, pa.string()))
        found = np.zeros((len(texts), hashes), np.int64)
        for n, hashed in _hashes(points):
            row = np.flatnonzero(np.diff(starts) == n)
            for number in range(hashes):
                found[row, number] = _slot(hashed[starts[row]], bits, number)
        return pd.Series(list(found))

    return runs.withColumn("slots", slots(column))


def bitmap_of(runs: DataFrame, bits: int) -> bytes:
    """The bitmap of all ``slots``: at most 8 MB, whatever the number of runs."""
    slot = F.col("slot") + 1
    parts = runs.select(F.explode("slots").alias("slot")).groupBy(
        F.bitmap_bucket_number(slot).alias("part")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    whole = bytearray(max(1 << bits, 8 * 4096) // 8)
    for p in parts:
        at = (p["part"] - 1) * 4096
        whole[at:at + 4096] = p["bits"]
    return bytes(whole)


def slot_counts(values: DataFrame, bitmap: bytes) -> DataFrame:
    """Rows (slot, n): how often the texts in ``value`` hold runs of each slot in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.frombuffer(bitmap, np.uint8), np.zeros(1 << COUNTER_BITS, np.int64)
        for texts in _small(batches):
            _, points, starts = _points(texts)
            for _, slots, _, _ in _found(points, starts, held, COUNTER_BITS, 1):
                np.add.at(counts, slots, 1)
        slots = np.flatnonzero(counts)
        for i in range(0, len(slots), 100_000):
            part = slots[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["slot", "n"])

    texts = values.select("value").where("value is not null")
    return texts.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def with_runs(values: DataFrame, bitmap: bytes, bits: int, hashes: int) -> DataFrame:
    """Rows (value, piece): the runs of each text that the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bitmap, np.uint8)
        for texts in _small(batches):
            joined, points, starts = _points(texts)
            hits = list({(int(r), joined[a:a + n]) for n, _, at, row in _found(points, starts, held, bits, hashes)
                         for a, r in zip(at.tolist(), row.tolist(), strict=True)})
            if hits:
                rows, pieces = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [texts.take(pa.array(rows, pa.int32())), pa.array(pieces, pa.string())], names=["value", "piece"])

    return values.select("value").where("value is not null").mapInArrow(run, "value string, piece string")
