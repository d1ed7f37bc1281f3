"""Byte-level BPE encoding and decoding with a given list of ranked tokens.

Encoding works on distinct words. Each task numbers the words of its documents,
block by block, and folds those of a block together: the bytes of each are a row
of a matrix, and a step merges every row's pair of the lowest rank, looked up in a
map. The numbers then become token ids. Words that a sample finds frequent are
folded once beforehand. Decoding looks pieces up in a literal list and
concatenates them.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from stowage.llm.tables import Scratch

#: Words numbered together; a document is never cut, so one can be larger.
WORDS_PER_BLOCK = 300_000
#: Documents whose words are counted, and words folded beforehand, at most: some 8 MB.
SAMPLED_DOCS, KEPT_WORDS = 20_000, 100_000
#: Matches of more bytes are encoded by the tiktoken library: a fold takes quadratic time in them.
LONGEST_FOLD = 256
#: Words up to these numbers of bytes are folded together, so many cells of ids at once.
_WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, LONGEST_FOLD)
CELLS_AT_ONCE = 200_000
#: Places over which the map's rows are laid.
_PLACES = 1 << 17
#: A place of the map without an entry, and the rank of a pair that doesn't merge.
_EMPTY, _NONE = np.uint32(0xFFFFFFFF), 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def _merged_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The two tokens whose merge makes each token, by applying the lower ranks to its bytes."""
    pairs = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            at = min(range(len(found)), key=found.__getitem__)
            if found[at] >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pairs[ranks[parts[0]], ranks[parts[1]]] = rank
    return pairs


@dataclass
class RankMap:
    """Ranks of merges by pair of ids, and what the fold needs besides.

    The pair (a, b) has its entry, ``a * 65536 + rank`` in 32 bits, at place
    ``starts[a] + b``; rows of first tokens are laid into each other where they
    leave room, the longest ones first. Other places belong to another a, or hold
    ``_EMPTY``. ``fill`` is an id that no token has.
    """

    starts: np.ndarray
    entries: np.ndarray
    byte_ids: np.ndarray
    ranks: dict[bytes, int]
    unreachable: dict[str, int] = field(default_factory=dict)

    @property
    def fill(self) -> int:
        return len(self.starts) - 1

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each merge of two ids; ``_NONE`` where they don't merge."""
        entry = self.entries[self.starts[a] + b]
        return np.where((entry >> 16 == a) & (entry != _EMPTY), entry & 0xFFFF, _NONE).astype(np.int32)


@lru_cache(maxsize=4)
def _rank_map(path: str) -> RankMap:
    ranks = read_ranks(path)
    last = max(ranks.values())
    if last >= 1 << 16:
        raise ValueError(f"{path} has ranks of more than 16 bits, which the map doesn't hold")
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), rank in _merged_pairs(ranks).items():
        rows.setdefault(a, []).append((b, rank))
    entries = np.full(_PLACES + last + 2, _EMPTY, np.uint32)
    starts = np.zeros(last + 2, np.int32)
    rng = np.random.default_rng(1)
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        columns = np.array([b for b, _ in row])
        tried = rng.integers(0, _PLACES, 256 if len(row) > 2 else 16)
        free = (entries[tried[:, None] + columns] == _EMPTY).all(axis=1)
        while not free.any():
            tried = rng.integers(0, _PLACES, 4096)
            free = (entries[tried[:, None] + columns] == _EMPTY).all(axis=1)
        starts[a] = start = tried[free.argmax()]
        entries[start + columns] = np.array([a << 16 | rank for _, rank in row], np.uint32)
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    return RankMap(starts, entries, byte_ids, ranks, _unreachable(ranks))


def _fold_rows(ids: np.ndarray, table: RankMap) -> np.ndarray:
    """Rows of ids, filled up at their ends, with all merges made in the order of ranks.

    A step makes one merge in each row that has one left: of the pairs of the
    lowest rank the first. Each such row becomes shorter by one.
    """
    out = np.full(ids.shape, table.fill, np.int32)
    rows = np.arange(len(ids))
    ranks = table.merges(ids[:, :-1], ids[:, 1:])
    while len(rows):
        width = ids.shape[1]
        each = np.arange(len(rows))
        at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
        rank = ranks[each, at] if width > 1 else np.full(len(rows), _NONE, np.int32)
        merging = rank != _NONE
        if not merging.all():
            out[rows[~merging], :width] = ids[~merging]
            rows, ids, ranks, at, rank = (x[merging] for x in (rows, ids, ranks, at, rank))
            each = each[: len(rows)]
            if not len(rows):
                break
        ids[each, at] = rank
        kept = np.ones(ids.shape, bool)
        kept[each, at + 1] = False
        ids = ids[kept].reshape(len(rows), width - 1)
        kept = np.ones(ranks.shape, bool)
        kept[each, at] = False
        ranks = ranks[kept].reshape(len(rows), width - 2)
        left, right = each[at > 0], each[at < width - 2]
        for row, first in ((left, at[left] - 1), (right, at[right])):
            ranks[row, first] = table.merges(ids[row, first], ids[row, first + 1])
    return out


def fold_words(words: pa.Array, table: RankMap) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of matches of the pattern, one after the other, and how many each match has.

    Merges the bytes of a match in the order of ranks; words of like length are
    folded together. Tokens that no merge makes are taken as they are, and the
    rare very long matches are left to the tiktoken library.
    """
    words = words.cast(pa.string())
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    letters = table.byte_ids[data]
    sizes = np.diff(offsets)
    counts = np.zeros(len(words), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # places of words, and their ids in rows
    shortest = 0
    for width in _WIDTHS:
        of_width = np.flatnonzero((sizes > shortest) & (sizes <= width))
        shortest = width
        step = max(1, CELLS_AT_ONCE // width)
        for some in (of_width[i : i + step] for i in range(0, len(of_width), step)):
            column = np.arange(width, dtype=np.int32)
            inside = column < sizes[some, None]
            ids = np.full(inside.shape, table.fill, np.int32)
            ids[inside] = letters[(offsets[some, None] + column)[inside]]
            ids = _fold_rows(ids, table)
            found.append((some, ids))
            counts[some] = (ids != table.fill).sum(axis=1)
    others: dict[int, list[int]] = {}
    longer = np.flatnonzero(sizes > LONGEST_FOLD)
    if len(longer):
        others |= zip(longer.tolist(), _long_matches(table.ranks, words.take(pa.array(longer))), strict=True)
    if table.unreachable:
        whole = pc.index_in(words, pa.array(list(table.unreachable), pa.string()).cast(words.type))
        for i in np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False)).tolist():
            others[i] = [table.unreachable[words[i].as_py()]]
    for i, ids in others.items():
        counts[i] = len(ids)
    starts = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int32)
    for some, ids in found:
        if others:
            plain = ~np.isin(some, list(others))
            some, ids = some[plain], ids[plain]
        place = starts[some, None] + np.arange(ids.shape[1])
        real = ids != table.fill
        flat[place[real]] = ids[real]
    for i, ids in others.items():
        flat[starts[i] : starts[i] + len(ids)] = ids
    return flat, counts


def fold_merges(word: Column, path: str) -> Column:
    """Token ids of one match of the pattern, by merging its bytes in the order of ranks."""
    table = _rank_map(path)

    @F.arrow_udf("array<int>")
    def folded(words: pa.Array) -> pa.Array:
        flat, counts = fold_words(pc.fill_null(words, ""), table)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=words.is_null())

    return folded(word)


def _unreachable(ranks: dict[bytes, int]) -> dict[str, int]:
    """Tokens that no merge makes but that are a whole match: tiktoken takes them as they are."""
    made = set(_merged_pairs(ranks).values())
    out = {}
    for token, rank in ranks.items():
        if len(token) > 1 and rank not in made:
            try:
                out[token.decode()] = rank
            except UnicodeDecodeError:
                continue
    return out


def _parts(batch: pa.RecordBatch):
    """A batch of lists of words in parts with not many more words than a block."""
    sizes = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
    at = 0
    while at < len(batch):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + WORDS_PER_BLOCK, "right")))
        yield batch.slice(at, end - at)
        at = end


def _matches(text_col: str, pattern: str) -> Column:
    return F.regexp_extract_all(
        F.coalesce(F.col(text_col), F.lit("")), F.lit(f"(?U)({pattern})"), F.lit(0)
    )


def frequent_words(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str, sample: int, kept: int
) -> dict[str, list[int]]:
    """Token ids of the words that ``sample`` documents, chosen by a hash, use most often.

    These words are only encoded beforehand, so the choice changes no result.
    """
    share = min(1.0, sample / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    words = docs.where(chosen).select(F.explode(_matches(text_col, pattern)).alias("word"))
    counts = words.groupBy("word").count().where("count > 1")
    top = counts.orderBy(F.col("count").desc(), "word").limit(kept).select("word")
    top = Scratch(docs.sparkSession, "bpe").write(top.repartition("word"), "frequent")
    rows = top.select("word", fold_merges(F.col("word"), ranks_path).alias("ids")).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist(), strict=True))


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLED_DOCS,
    kept: int = KEPT_WORDS,
) -> DataFrame:
    """Per row of ``docs``: its id and ``ids``, the token ids of the whole text.

    Every match of ``pattern`` is encoded by itself; there are no special tokens.
    Nothing is shuffled: a block of documents is numbered, its words that aren't
    known beforehand are folded, and it is put together within one task.

    Defined cases: NULL and empty texts have no ids; repeated rows give repeated
    rows; a NULL id stays NULL; an empty table gives an empty one; other columns
    of ``docs`` don't matter.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    context = docs.sparkSession.sparkContext
    known = frequent_words(docs, ranks_path, pattern, text_col, sample, kept)
    lists = pa.array(list(known.values()), pa.list_(pa.int32()))
    places = context.broadcast({word: i for i, word in enumerate(known)})
    frequent = context.broadcast((
        np.array(lists.flatten(), np.int32), np.array(np.diff(lists.offsets.to_numpy()), np.int32)))
    ranks = context.broadcast(_rank_map(ranks_path))
    matches = docs.select(F.col(id_col).alias("id"), _matches(text_col, pattern).alias("words"))
    id_type = matches.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches):
        known, table = places.value, ranks.value
        known_flat, known_length = frequent.value

        def encoded(block):
            """The block's documents: its words numbered, those not known folded, then put together."""
            lists = block.column("words")
            found = lists.flatten().dictionary_encode()
            words = found.dictionary.to_pylist()
            place = np.fromiter((known.get(word, -1) for word in words), np.int32, len(words))
            new = np.flatnonzero(place < 0)
            place[new] = np.arange(len(known), len(known) + len(new))
            ids, counts = fold_words(found.dictionary.take(pa.array(new)), table)
            flat = np.concatenate([known_flat, ids])
            length = np.concatenate([known_length, counts])
            starts = np.cumsum(length) - length
            codes = place[found.indices.to_numpy(zero_copy_only=False)]
            sizes = length[codes]
            ends = np.cumsum(sizes, dtype=np.int64)
            total = int(ends[-1]) if len(ends) else 0
            # Where each token of the block stands in the list of pieces.
            at = np.repeat((starts[codes] - (ends - sizes)).astype(np.int32), sizes)
            at += np.arange(total, dtype=np.int32)
            tokens = np.concatenate([[0], ends])
            bounds = tokens[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32)
            result = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat[at], pa.int32()))
            return pa.RecordBatch.from_arrays(
                [block.column("id").cast(arrow_id), result], names=[id_col, "ids"])

        for batch in batches:
            yield from map(encoded, _parts(batch))

    out = StructType().add(id_col, id_type).add("ids", ArrayType(IntegerType()))
    return matches.mapInArrow(run, out)


def _long_matches(ranks: dict[bytes, int], words: pa.Array) -> list[list[int]]:
    """Ids of the rare very long matches, from the library itself."""
    import tiktoken

    own = tiktoken.Encoding("given", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return [own.encode_ordinary(word) for word in words.to_pylist()]


def _literal(values: str, kind: str) -> Column:
    """A list given as JSON, as one literal of the optimized plan."""
    return F.from_json(F.lit(values), kind)


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", result_col: str = "decoded"):
    """The columns of ``tokens`` and the bytes that its ids stand for.

    Defined cases: a NULL list and one without ids give no bytes; ids outside
    the vocabulary stand for nothing.
    """
    ranks = read_ranks(ranks_path)
    names = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        names[rank] = token.hex()
    pieces = _literal(json.dumps(names), "array<string>")
    joined = F.array_join(F.transform(ids_col, lambda i: F.get(pieces, i)), "")
    return tokens.withColumn(result_col, F.unhex(F.coalesce(joined, F.lit(""))))


def little_endian(ids: Column, ranks_path: str) -> Column:
    """Ids as unsigned 32-bit integers, lowest byte first."""
    top = max(read_ranks(ranks_path).values())
    names = _literal(json.dumps([i.to_bytes(4, "little").hex() for i in range(top + 1)]),
                     "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(names, i)), ""))
