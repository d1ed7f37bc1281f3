"""Token ids as length-delimited binary records with an index of their places.

A record, all numbers little-endian:

    8 bytes  length of the body
    4 bytes  masked CRC-32 of these 8 bytes
    body     1 byte 1 if there is an id, 8 bytes id, 1 byte width, then ids of that width
    4 bytes  masked CRC-32 of the body
    1 byte   line feed

Spark's text sink writes the records, a line feed ends each, so files appear
whole or not at all and any file system that Spark knows will do. The index, a
table beside the data, has file, place, length and first token number of every
record, so records can be read in any order.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Added to the rotated checksum, as in a well-known record format (fixed value).
MASK = 0xA282EAD8
_HEAD, _FOOT = struct.Struct("<QI"), struct.Struct("<I")
_ID = struct.Struct("<?qB")
#: Words whose ids a worker remembers; beyond it only those that came again are kept.
_REMEMBERED = 450_000
#: Words encoded in one call, and the word between them, which is a token of its own.
_JOINED, _BETWEEN = 64, "|"
#: Marks that are a token of their own behind letters.
_MARKS = [".", ","]
#: Bytes of text whose words are looked up together, at least one document.
_PART_BYTES = 5_000_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its line feed."""
    body = _ID.pack(doc_id is not None, doc_id or 0, width) + ids
    length = struct.pack("<Q", len(body))
    return b"".join(
        (length, _FOOT.pack(masked_crc(length)), body, _FOOT.pack(masked_crc(body)))
    )


def frames(data: bytes):
    """(place, length, id, token ids) of each record of a file; a damaged file raises."""
    view, at = memoryview(data), 0
    while at < len(data):
        length, check = _HEAD.unpack_from(view, at)
        if masked_crc(view[at : at + 8]) != check:
            raise ValueError(f"damaged record length at byte {at}")
        body = view[at + 12 : at + 12 + length]
        end = at + 12 + length
        if len(body) < length or masked_crc(body) != _FOOT.unpack_from(view, end)[0]:
            raise ValueError(f"damaged record at byte {at}")
        named, doc_id, width = _ID.unpack_from(body)
        ids = np.frombuffer(body[_ID.size :], f"<u{width}")
        yield at, end + 5 - at, doc_id if named else None, ids
        at = end + 5


@lru_cache(maxsize=2)
def _tokenizer(definition: str, special_as_text: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.encode_special_tokens = special_as_text
    return made


class _WordIds:
    """Ids of words between white space, which this kind of tokenizer encodes one by one.

    It also lower-cases, and takes letters and marks apart; so capitals a-z and
    a stop or comma behind letters need no encoding of their own.
    """

    def __init__(self, definition: str, width: int, special_as_text: bool = True):
        self.tokenizer = _tokenizer(definition, special_as_text)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # Texts that hold such a string in any case are encoded as they are.
        self.special = [] if special_as_text else [t.content for t in added]
        self.kind = np.dtype(f"<u{width}")
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()
        between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in _MARKS}
        single = {m: ids[0] for m, ids in marks.items() if len(ids) == 1}
        self.stripped = pa.array(list(single), pa.string())
        self.marks = np.array([0, *single.values()], self.kind)

    def lowered(self, texts: pa.Array) -> pa.Array:
        whole = pc.fill_null(texts, "")
        if not self.special:
            return pc.ascii_lower(whole)
        hits = [pc.match_substring(whole, token, ignore_case=True) for token in self.special]
        return pc.if_else(reduce(pc.or_, hits), whole, pc.ascii_lower(whole))

    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        ends = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, -1), self.stripped), -1)
        stems = pc.utf8_slice_codeunits(words, 0, -1)
        marked = pc.and_(pc.greater_equal(ends, 0), pc.ascii_is_alpha(stems))
        found = pc.if_else(marked, stems, words).dictionary_encode()
        mark = np.where(marked.to_numpy(zero_copy_only=False), ends.to_numpy() + 1, 0)
        stem = found.indices.to_numpy()
        pieces = self.pieces(found.dictionary.to_pylist())
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.kind.itemsize
        length = sizes[stem] + (mark > 0)
        last = np.cumsum(length) - 1
        # A marked word's last place lies behind its stem and is written over.
        flat = np.append(np.frombuffer(b"".join(pieces), self.kind), self.kind.type(0))
        starts = (np.cumsum(sizes) - sizes)[stem]
        out = flat[np.repeat(starts - (last + 1 - length), length) + np.arange(length.sum())]
        out[last[mark > 0]] = self.marks[mark[mark > 0]]
        return out, length

    def _encoded(self, words: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array(code, e.ids).tobytes() for e in found]

    def _beside(self, words: list[str]) -> list[bytes]:
        """Ids of words, many in one call; none of them holds the word between."""
        texts = [f" {_BETWEEN} ".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array([i for e in found for i in (*e.ids, self.between)], self.kind)
        ends = np.flatnonzero(ids == self.between).tolist()
        data, width = ids.tobytes(), self.kind.itemsize
        starts = [0, *(e + 1 for e in ends)]
        return [data[a * width : b * width] for a, b in zip(starts, ends, strict=False)]

    def pieces(self, words: list[str]) -> list[bytes]:
        """Ids of each of these distinct words."""
        known = self.known
        self.again.update(w for w in words if w in known)
        new = [w for w in words if w not in known]
        if len(known) + len(new) > _REMEMBERED:
            known = self.known = {w: known[w] for w in self.again}
            self.again = set()
        joined = [w for w in new if _BETWEEN not in w] if self.between is not None else []
        alone = new if self.between is None else [w for w in new if _BETWEEN in w]
        for some, encode in ((joined, self._beside), (alone, self._encoded)):
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                known.update(zip(part, encode(part), strict=True))
        return [known[w] for w in words]


@lru_cache(maxsize=1)
def _word_ids(definition: str, width: int, special_as_text: bool) -> _WordIds:
    """One for all tasks of a worker, with the words it remembers."""
    return _WordIds(definition, width, special_as_text)


def encode_texts(texts: pa.Array, words_of: _WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each with its end id, and where each text begins."""
    lists = pc.ascii_split_whitespace(words_of.lowered(texts))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    filled = lists.flatten()
    found = filled.dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False)
    flat, length = words_of.table(found.dictionary)
    start = np.cumsum(length) - length
    sizes = length[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((start[codes] - (ends - sizes)).astype(np.int32), sizes)
    at += np.arange(total, dtype=np.int32)
    ids = flat[at]
    bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    ids = np.insert(ids, bounds[1:], end_id)
    return ids, bounds + np.arange(len(bounds))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) cut by the bytes of their texts."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + _PART_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def write_records(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    special_as_text: bool = True,
) -> None:
    """Encodes whole texts and writes records in ascending order of ids to ``folder/data``.

    The tokenizer must drop white space and case, and take letters and marks
    apart, as one of word-level BPE does: then words are encoded one by one.
    Strings of special tokens in a text are ordinary text, or with
    ``special_as_text=False`` those tokens, as the library has it by default.

    Defined cases: a NULL text counts as an empty one, which has only the end
    id; rows with a NULL id come first; rows with one id follow each other in
    the order of a hash of their texts; an empty table writes no record; other
    columns of ``docs`` don't matter.
    """
    from tokenizers import Tokenizer

    definition = Tokenizer.from_file(tokenizer_path)
    width = 2 if max(definition.get_vocab_size(), end_id) < 1 << 16 else 4
    shared = docs.sparkSession.sparkContext.broadcast(definition.to_str())
    order = [F.col("id"), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        words_of = _word_ids(shared.value, width, special_as_text)
        for batch in _parts(batches):
            ids, bounds = encode_texts(batch.column(1), words_of, end_id)
            names = batch.column(0).to_pylist()
            out = [
                frame(name, ids[a:b].tobytes(), width)
                for name, a, b in zip(names, bounds, bounds[1:], strict=False)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
            del ids, out
            pa.default_memory_pool().release_unused()  # a worker's peak is the sum of what it keeps

    framed = (
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "value binary")
    )
    framed.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").text(
        f"{folder}/data"
    )


def _data_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")
    return files.select(F.substring_index("path", "/", -1).alias("file"), "content")


def index_records(spark: SparkSession, folder: str) -> DataFrame:
    """Reads all records, checks them, and writes the index to ``folder/index``.

    Per record, in the order of files: ``file``, ``place`` and ``length`` in
    bytes, ``doc_id``, ``n_tokens``, ``ids_crc32`` of the ids as unsigned 32-bit
    integers, and ``start``, the number of ids in all records before it.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(*(c for c in batch.columns), strict=True):
                rows = [
                    (at, length, doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for at, length, doc, ids in frames(data.as_buffer().to_pybytes())
                ]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(rows), pa.string()), *columns],
                    names=["file", "place", "length", "doc_id", "n_tokens", "ids_crc32"],
                )

    places = _data_files(spark, folder).mapInArrow(
        run, "file string, place bigint, length bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
    )
    places.write.mode("overwrite").parquet(f"{folder}/places")
    places = spark.read.schema(places.schema).parquet(f"{folder}/places")
    files = places.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row per file
    files = files.select("file", F.coalesce(
        F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    ).alias("base"))
    inside = W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    index = places.join(files, "file").withColumn(
        "start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    ).drop("base")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/places")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and the columns of ``wanted`` for the wanted ``doc_id``s, or all records.

    The index gives the places, and each file is read once for its records, so
    an epoch in a new order costs one pass: order ``wanted`` by any column of
    its own after this.
    """
    index = spark.read.parquet(f"{folder}/index").select("file", "place", "length", "doc_id")
    if wanted is not None:
        index = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def pick(places: pa.Table, files: pa.Table) -> pa.Table:
        docs, lists = [], []
        if files.num_rows:
            data = files.column("content")[0].as_py()
            for at, length in zip(places.column("place").to_pylist(),
                                  places.column("length").to_pylist(), strict=True):
                _, _, doc, ids = next(frames(data[at : at + length]))
                docs.append(doc)
                lists.append(ids.astype(np.int32))
        return pa.table({"doc_id": pa.array(docs, pa.int64()),
                         "ids": pa.array(lists, pa.list_(pa.int32()))})

    read = index.groupBy("file").cogroup(_data_files(spark, folder).groupBy("file")).applyInArrow(
        pick, "doc_id bigint, ids array<int>"
    )
    return read if wanted is None else read.join(wanted, "doc_id")
