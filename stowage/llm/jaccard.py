"""Jaccard join of word n-grams by grouped prefixes, and the groups it links.

A document is the set of its distinct word n-grams (shingles). Two sets can
only be similar enough if their prefixes, the rarest of their shingles in one
order for all, share a shingle. Documents with one prefix and size form a group
and are joined as one; pairs of groups are filtered, and only then are members
looked at and compared by their texts.

Large groups of near copies would give all their pairs. So a first round links
each group to its neighbour and to the first one in every list of groups that
share a shingle. A second round takes all remaining pairs, those whose members
aren't connected yet. No pair that could connect two components is left out,
so components are exact, and no list is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stowage.llm.components import connected_components
from stowage.llm.tables import Scratch

WORDS = 5
PERCENT = 80
#: Counters of the sketch that orders shingles by frequency: 2 to this, a byte each, at most.
#: Any order gives right results, so a full sketch only costs more comparisons.
MAX_SKETCH_BITS = 23
#: What a counter of the sketch holds at most; such a shingle's list is dealt to many tasks.
FULL = 255
SALTS = 64
#: 64-bit words of a set's bitmap, which bounds what two sets can share.
BITMAP = 16
#: Nodes before it, in a random order, that a node of an unconnected list is compared with.
REACH = 4
_CHUNKS = 64
_BATCH = 2_000_000
#: Bytes of texts whose shingles are hashed together.
BYTES_AT_ONCE = 1_000_000
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all of them at a time; long ones by themselves."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    start, size = offsets[:-1].astype(np.int64), np.diff(offsets)
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))  # from every byte on
    out = _scrambled((eights[start] & _FIRST_BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _STEP))
    rest = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    for at in range(8, LONG_WORD, 8):
        rest = rest[size[rest] > at]
        if not len(rest):
            break
        more = eights[start[rest] + at] & _FIRST_BYTES[np.minimum(size[rest] - at, 8)]
        out[rest] = _scrambled(out[rest] * _STEP + more)
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return out


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles one after the other, repeated ones too, and how many each text has.

    Words are what white space of ASCII leaves, with A-Z lower-cased. Fewer
    than ``size`` words are one shingle; no word is no shingle.
    """
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed))
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    h = np.concatenate([_word_hashes(words.flatten()), np.zeros(size, np.uint64)])
    length = np.minimum(n, size)
    counts = np.where(n > 0, n - length + 1, 0)
    # Where in the words each shingle begins: those of a text follow each other.
    first = np.arange(int(counts.sum())) + np.repeat((np.cumsum(n) - n) - (np.cumsum(counts) - counts), counts)
    each = np.repeat(length, counts)
    out = each.astype(np.uint64)
    for i in range(size):
        longer = out * _STEP + h[first + i]
        out = longer if (length >= size).all() else np.where(each > i, longer, out)
    return _scrambled(out), counts


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    values, counts = shingles(texts, size)
    out = []
    for end, count in zip(np.cumsum(counts), counts, strict=True):
        own = np.sort(values[end - count : end])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if count else own)
    return out


def _text_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``BYTES_AT_ONCE``; a single text may be larger."""
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
        yield texts.slice(at, end - at)
        at = end


def _frequency_sketch(docs: DataFrame, text_col: str, size: int, bits: int) -> np.ndarray:
    """Counts of shingles by the low bits of their hash, over all documents; ``FULL`` means more."""
    mask = np.uint64((1 << bits) - 1)

    def count(batches):
        total = np.zeros(1 << bits, np.uint8)
        waiting: list[np.ndarray] = []

        def add():
            found = np.sort(np.concatenate(waiting))
            waiting.clear()
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else found)
            own = found[first]
            total[own] = np.minimum(total[own] + np.diff(first, append=len(found)), FULL)

        pending = 0
        for batch in batches:
            for texts in _text_parts(batch.column(0)):
                waiting.append((shingles(texts, size)[0] & mask).astype(np.uint32))
                pending += len(waiting[-1])
                if pending > _BATCH:
                    add()
                    pending = 0
        if waiting:
            add()
        if total.any():
            yield _packed(enumerate(total.reshape(_CHUNKS, -1)))

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = np.frombuffer(zlib.decompress(data), np.uint8).astype(np.uint16)
                old = totals.get(chunk)
                totals[chunk] = new if old is None else np.minimum(new + old, FULL)
        if totals:
            yield _packed((k, v.astype(np.uint8)) for k, v in totals.items())

    parts = (
        docs.select(text_col).mapInArrow(count, "chunk int, counts binary")
        .repartition("chunk").mapInArrow(merge, "chunk int, counts binary").collect()
    )
    sketch = np.zeros((_CHUNKS, (1 << bits) // _CHUNKS), np.uint8)
    for row in parts:
        sketch[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return sketch.reshape(-1)


def _packed(chunks: Iterator) -> pa.RecordBatch:
    rows = [(i, zlib.compress(part.tobytes(), 1)) for i, part in chunks]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
        names=["chunk", "counts"],
    )


def prefix_length(n: int, percent: int) -> int:
    """How many of n shingles of a set must be looked at to meet every similar one."""
    return n - -(-n * percent // 100) + 1


def text_key(text: Column) -> Column:
    """A hash that tells rows of one id apart by their texts."""
    return F.xxhash64(F.lit("text"), text).alias("text_key")


def _prepare(docs: DataFrame, sketch, bits: int, id_col: str, text_col: str, size: int, percent: int):
    """Per row: id, set size, hashes of the set and of the group, prefix, its full counters, bitmap.

    The prefix is given once per group and task, which is all the join needs.
    """
    mask = np.uint64((1 << bits) - 1)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            at = 0
            for texts in _text_parts(batch.column(1)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                sets = shingle_sets(texts, size)
                n = np.array([len(own) for own in sets], np.int32)
                every = np.concatenate(sets)
                often = counts[(every & mask).view(np.int64)]
                marks = np.zeros((len(sets), 64 * BITMAP), np.uint8)
                marks[np.repeat(np.arange(len(sets)), n), (every >> np.uint64(40)).view(np.int64) % (64 * BITMAP)] = 1
                bitmaps = np.packbits(marks, axis=1, bitorder="little").view(np.int64)
                empty = n == 0
                rows = []
                for own, start in zip(sets, np.cumsum(n) - n, strict=True):
                    if not len(own):
                        rows.append((0, 0, None, 0))
                        continue
                    freq = often[start : start + len(own)]
                    order = np.argsort(freq, kind="stable")[: prefix_length(len(own), percent)]
                    prefix = own[order].view(np.int64)
                    group = xxhash.xxh3_64_intdigest(prefix.tobytes() + len(own).to_bytes(8, "little"))
                    group -= 1 << 63
                    first = group not in seen
                    seen.add(group)
                    full = int((freq[order] == FULL).sum()) if first else 0
                    rows.append((_key(own), group, prefix if first else None, full))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(n),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                        pa.array([r[3] for r in rows], pa.int32()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BITMAP),
                            pa.array(bitmaps.reshape(-1)), mask=pa.array(empty)),
                    ],
                    names=["doc_id", "text_key", "n", "set_key", "gid", "prefix", "n_full", "bitmap"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col, text_key(F.col(text_col)))
    return rows.mapInArrow(
        run, "doc_id bigint, text_key bigint, n int, set_key bigint, gid bigint, prefix array<bigint>, n_full int, "
        "bitmap array<bigint>"
    )


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sizes alone allow the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _sides(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias(a), F.greatest(a, b).alias(b)]


def _neighbours(lists: DataFrame, by: list[str], node: str, size: str, percent: int) -> DataFrame:
    """Pairs of each node with the one before it and with the first one of its list."""
    w = W.partitionBy(*by).orderBy(size, node)
    rows = lists.select(
        F.col(node).alias("a"), F.col(size).alias("n"),
        F.lag(node).over(w).alias("b1"), F.lag(size).over(w).alias("n1"),
        F.first(node).over(w).alias("b2"), F.first(size).over(w).alias("n2"),
    )
    pairs = rows.select("a", "n", F.explode(F.array(
        F.struct(F.col("b1").alias("b"), F.col("n1").alias("m")),
        F.struct(F.col("b2").alias("b"), F.col("n2").alias("m")),
    )).alias("p")).select("a", "n", "p.b", "p.m")
    return pairs.where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))
                       & _fits(F.col("n"), F.col("m"), percent)).select(*_sides("a", "b"))


def _key(own: np.ndarray) -> int:
    """The hash that names a set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _who() -> Column:
    """What a pair needs to know of a node, so that no join has to look it up: its number, first id and set."""
    return F.struct("node", "rep", "set_key")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The numbers of those pairs (a, b) of nodes, as ``_who`` gives them, whose texts are similar enough.

    A node's text is that of its first id; where several rows have this id, the
    one whose set is the node's.
    """

    def run(batches):
        for batch in batches:
            at = 0
            for first in _text_parts(batch.column(4)):
                part = batch.slice(at, len(first))
                at += len(first)
                # Each text's set once, however many pairs it is in.
                texts = pa.concat_arrays([part.column(4), part.column(5)]).dictionary_encode()
                sets = shingle_sets(texts.dictionary, size)
                keys = [_key(own) for own in sets]
                places = texts.indices.to_pylist()
                out = []
                for i, (ka, kb) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    x, y = places[i], places[i + len(part)]
                    both = 0
                    if x is not None and y is not None and keys[x] == ka and keys[y] == kb:
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    out.append(both > 0 and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1)], names=["a", "b"]
                ).filter(pa.array(out, pa.bool_()))

    def side(name: str) -> list[Column]:
        return [F.col(f"{name}.node").alias(name), F.col(f"{name}.rep").alias(f"r{name}"),
                F.col(f"{name}.set_key").alias(f"k{name}")]

    def text(name: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(f"r{name}"), F.col("text").alias(f"t{name}"))

    rows = pairs.select(*side("a"), *side("b")).join(text("a"), "ra").join(text("b"), "rb")
    return rows.select("a", "b", "ka", "kb", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _may_match(a: str, b: str, percent: int) -> Column:
    """Whether two nodes of one list, structs with n, at and bitmap, can be similar enough.

    In the list of the first shingle that two sets share, ``at`` shingles of
    each come before it. And each bit that only one bitmap has stands for a
    shingle that only that set has. What is left must be enough.
    """
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    needed = F.ceil((n_a + n_b) * percent / (100 + percent))
    follow = F.least(n_a - F.col(f"{a}.at"), n_b - F.col(f"{b}.at"))

    def only(x: str, y: str) -> Column:
        return sum((F.bit_count(F.get(f"{x}.bitmap", F.lit(i)).bitwiseAND(
            F.bitwise_not(F.get(f"{y}.bitmap", F.lit(i))))) for i in range(BITMAP)), F.lit(0))

    shared = F.least(n_a - only(a, b), n_b - only(b, a))
    return (follow >= needed) & F.coalesce(shared >= needed, F.lit(True))


def _mixed(rows: DataFrame, by: str) -> DataFrame:
    """Rows of lists whose nodes lie in several components, with their largest one as ``main``."""
    lists = rows.groupBy(by).agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.max(F.struct("members", "component"))["component"].alias("main"),
    ).where("low <> high").select(by, "main")
    return rows.join(lists, by)


def _node(rows: DataFrame, node: str) -> Column:
    return F.struct(F.col(node).alias("id"), "n", "at", "bitmap", "component")


def _nearby(rows: DataFrame, by: str, node: str, percent: int) -> DataFrame:
    """Pairs of nodes in different components that stand close in a random order of their list."""
    w = W.partitionBy(by).orderBy(F.xxhash64(by, node), node)
    rows = rows.select(by, node, _node(rows, node).alias("a")).withColumn(
        "others", F.array(*[F.lag("a", k).over(w) for k in range(1, REACH + 1)])
    )
    pairs = rows.select("a", F.explode("others").alias("b")).where(
        F.col("b").isNotNull() & (F.col("a.component") != F.col("b.component"))
    )
    return pairs.where(_may_match("a", "b", percent)).select(
        F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def _crossing(rows: DataFrame, by: str, node: str, percent: int) -> DataFrame:
    """Pairs of nodes of a list that lie in different components, once per list they share.

    A pair has at least one node outside the list's main component, so only
    these nodes meet the whole list.
    """
    outside = rows.where("component <> main").select(by, _node(rows, node).alias("a"))
    others = rows.select(by, _node(rows, node).alias("b"), "main")
    one_way = (F.col("b.component") == F.col("main")) | (F.col("a.id") < F.col("b.id"))
    return outside.join(others, by).where(
        (F.col("a.component") != F.col("b.component")) & one_way & _may_match("a", "b", percent)
    ).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def _in_components(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes with their component."""
    return classes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _members(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes with their component and its number of classes."""
    members = _in_components(classes, roots)
    sizes = members.groupBy("component").agg(F.count("*").alias("members"))
    return members.join(sizes, "component")


def linked_documents(
    docs: DataFrame,
    size: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_sketch_bits: int = MAX_SKETCH_BITS,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, as ``linked_rows`` gives them."""
    return linked_rows(docs, size, percent, id_col, text_col, max_sketch_bits).drop("text_key")


def linked_rows(
    docs: DataFrame,
    size: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_sketch_bits: int = MAX_SKETCH_BITS,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``text_key``.

    Two documents are linked if their sets of shingles have
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    id that links lead to.

    Defined cases: NULL, empty and wordless texts have no shingles and no links;
    every row is a document, so rows with one id and different texts can have
    different components; a row with a NULL id has a NULL component unless its
    set occurs under an id; an empty table gives an empty one; other columns of
    ``docs`` don't matter.
    """
    spark = docs.sparkSession
    # Its many joins would each leave the driver a table to gather and a thread, however small the input is.
    scratch = Scratch(spark, "jaccard", adaptive_broadcasts=False)
    bits = min(max_sketch_bits, max(12, (32 * docs.count()).bit_length()))
    sketch = _frequency_sketch(docs, text_col, size, bits)
    prep = scratch.write(_prepare(docs, sketch, bits, id_col, text_col, size, percent), "prepared")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    # Lists of groups by shingle; a shingle of one group joins nothing.
    tokens = prep.where("prefix is not null").select(
        "gid", "n", (F.size("prefix") - F.col("n_full")).alias("plain"),
        F.posexplode("prefix").alias("at", "token"),
    ).select("token", "gid", "n", "at", (F.col("at") >= F.col("plain")).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod("gid", F.lit(SALTS))).otherwise(0).cast("int")
    w = W.partitionBy("token", "salt").orderBy("n", "gid")
    lists = tokens.withColumn("salt", salt).withColumns({
        "before": F.lag("gid").over(w), "after": F.lead("gid").over(w),
        "n_before": F.lag("n").over(w),
        "first": F.first("gid").over(w), "n_first": F.first("n").over(w),
    }).where("hot or before <> gid or after <> gid").drop("after")
    lists = scratch.write(lists, "lists")
    near = lists.select("gid", "n", F.explode(F.array(
        F.struct(F.col("before").alias("b"), F.col("n_before").alias("m")),
        F.struct(F.col("first").alias("b"), F.col("n_first").alias("m")),
    )).alias("p")).where(
        (F.col("p.b") != F.col("gid")) & _fits(F.col("n"), F.col("p.m"), percent)
    ).select(F.least("gid", "p.b").alias("a"), F.greatest("gid", "p.b").alias("b"))
    heads = lists.where("hot and first = gid").select("token", "gid", "n").distinct()
    group_pairs = near.unionByName(_neighbours(heads, ["token"], "gid", "n", percent)).distinct()

    # Members: documents of one set are one class, a node with a number of its own.
    classes = scratch.write(
        prep.where("n > 0").groupBy("gid", "set_key").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n")
        ).where("rep is not null").withColumn("node", F.monotonically_increasing_id()), "classes",
    )
    leaders = classes.groupBy("gid").agg(F.min(_who()).alias("node"), F.count("*").alias("k"))
    several = classes.join(leaders.where("k > 1").select("gid"), "gid").withColumn("node", _who())
    by_gid = lambda name, side: leaders.select(
        F.col("gid").alias(name), F.col("node").alias(side)
    )
    pairs = group_pairs.withColumnsRenamed({"a": "g", "b": "h"}).join(by_gid("g", "a"), "g").join(
        by_gid("h", "b"), "h").where("a <> b").select(*_sides("a", "b"))
    pairs = pairs.unionByName(_neighbours(several, ["gid"], "node", "n", percent)).distinct()
    links = scratch.write(_verified(pairs, texts, size, percent), "links")
    roots = scratch.write(connected_components(links, scratch, "first"), "roots")

    # What isn't connected yet: first pairs that stand close in a random order, then all pairs.
    bitmaps = prep.where("n > 0").groupBy("gid").agg(
        F.min("set_key").alias("low"), F.max("set_key").alias("high"), F.first("bitmap").alias("bitmap")
    ).select("gid", F.when(F.col("low") == F.col("high"), F.col("bitmap")).alias("bitmap"))
    open_lists = lists.select("token", "gid", "n", "at").distinct().join(bitmaps, "gid")
    for turn, pairs_of in enumerate((_nearby, _crossing)):
        members = scratch.write(_members(classes, roots), f"members-{turn}")
        # A group in several components counts as one of its own until its members are looked at.
        several_parts = F.col("low") != F.col("high")
        groups = members.groupBy("gid").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.max("members").alias("members"),
        ).select("gid", "members", F.struct(
            several_parts.alias("own"), F.when(several_parts, F.col("gid")).otherwise(F.col("low")).alias("number"),
        ).alias("component"))
        open_lists = scratch.write(_mixed(open_lists.join(groups, "gid"), "token"), f"open-{turn}")
        open_groups = pairs_of(open_lists, "token", "gid", percent).distinct().select(
            F.col("a").alias("g"), F.col("b").alias("h")
        )
        side = lambda name, s: members.select(  # noqa: B023, E731
            F.col("gid").alias(name), _who().alias(s), F.col("component").alias(f"c_{s}")
        )
        across = open_groups.join(side("g", "a"), "g").join(side("h", "b"), "h").where("c_a <> c_b")
        within = members.withColumns(
            {"node": _who(), "at": F.lit(0), "bitmap": F.lit(None).cast("array<bigint>")})
        inside = pairs_of(_mixed(within, "gid"), "gid", "node", percent)
        open_pairs = across.select(*_sides("a", "b")).unionByName(inside).where("a <> b").distinct()
        more = scratch.write(_verified(open_pairs, texts, size, percent), f"more-{turn}")
        if not more.isEmpty():
            # What the links so far connect is one link for each node.
            known = roots.select(F.col("node").alias("a"), F.col("component").alias("b"))
            roots = scratch.write(
                connected_components(known.unionByName(more), scratch, f"again-{turn}"), f"roots-{turn}")
        open_lists = open_lists.drop("component", "members", "main")
    scratch.drop("lists", "links", "open-0", "open-1", "more-0", "more-1", "members-0", "members-1")
    numbered = _in_components(classes, roots)
    least = numbered.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = numbered.join(least, "component").select("gid", "set_key", "component_id")
    return (
        prep.select("doc_id", "text_key", "n", "gid", "set_key")
        .join(named, ["gid", "set_key"], "left")
        .select(
            "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
            F.coalesce("component_id", "doc_id").alias("component_id"), "text_key",
        )
    )
