"""Phrase collocations: frequent phrases of a language whose words belong together.

Texts are cut into blocks of words. Numpy prefix polynomials give every n-gram
of a block a 64-bit fingerprint in a few passes over arrays. Each block sends a
distinct fingerprint once, with its count and a pointer to one occurrence; the
shuffle adds counts up, and only pointers of frequent fingerprints go back to
their blocks. An n-gram can only be frequent if both n-grams one word shorter
inside it are, so longer ones are tried only where the pointers that came back
say so: nothing frequent is lost. At the end blocks compare all occurrences of
a frequent fingerprint with the words at its pointer, and only then are phrases
made and counted as texts; so fingerprints that collide can't add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from stowage.llm.tables import Scratch

#: Where texts are cut into pieces, what parts words, and what stands for a missing language.
MARKS, SPACES, UNKNOWN = b".,;:!?\n\x0b\x0c\r", b" \t", "und"
#: Bytes of text in a block, at least one document; fingerprints that one task adds up, roughly.
BLOCK_BYTES, SHARE = 12_000_000, 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)

_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(MARKS)] = 1, 2


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Polynomial:
    """Prefix sums of values times powers of a base, modulo 2 to the 64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = _powers(_BACK, n)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of the values in each span."""
        whole = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return _scrambled(whole + (ends - starts).astype(np.uint64) * np.uint64(_BACK))


def _bytes_and_offsets(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole, offsets - offsets[0]


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and the number of each word's piece; A-Z become a-z."""
    data = np.frombuffer(b"\n".join(texts), np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind == 0
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])])
    return words, np.searchsorted(np.flatnonzero(kind == 2), starts)


class _Block:
    """The words of a block as codes, with n-grams' fingerprints."""

    def __init__(self, lang: str, words: pa.Array, codes: bytes, n_words: int):
        packed = np.frombuffer(pa.decompress(codes, 4 * n_words, codec="zstd"), np.int32)
        self.words, self.n = words, n_words
        self.codes = np.abs(packed) - 1
        self.piece = np.cumsum(packed < 0)  # a word that begins a piece is negative
        data, offsets = _bytes_and_offsets(words)
        letters = _Polynomial(data.astype(np.uint64) + np.uint64(1))
        seed = np.frombuffer(lang.encode(), np.uint8).astype(np.uint64) + np.uint64(257)
        own = _Polynomial(seed).spans(np.zeros(1, np.int64), np.array([len(seed)]))
        self.word_prints = _scrambled(letters.spans(offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)) ^ own)
        self._grams = None

    def prints(self, at: np.ndarray, m: int) -> np.ndarray:
        """Fingerprints of the n-grams of m words at these places."""
        if m == 1:
            return self.word_prints[self.codes[at]]
        if self._grams is None:
            self._grams = _Polynomial(self.word_prints[self.codes])
        return self._grams.spans(at, at + m)

    def known(self, pointers: np.ndarray, m: int, among: np.ndarray) -> np.ndarray:
        """Which of the places have an n-gram whose fingerprint a pointer has, and that pointer's number."""
        prints = self.prints(pointers, m)
        order = np.argsort(prints)
        prints = prints[order]
        mine = self.prints(among, m)
        marks = np.zeros(1 << 20, bool)  # most places are left out before they are looked up
        marks[(prints & np.uint64(0xFFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(marks[(mine & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.searchsorted(prints, mine[maybe])
        hit = place < len(prints)
        hit[hit] = prints[place[hit]] == mine[maybe[hit]]
        return maybe[hit], order[place[hit]]

    def starts(self, m: int) -> np.ndarray:
        """Places where m words follow each other in a piece."""
        at = np.arange(max(0, self.n - m + 1))
        return at[self.piece[at] == self.piece[at + m - 1]] if m > 1 and len(at) else at

    def tried(self, m: int, shorter: np.ndarray) -> np.ndarray:
        """Places of m-grams both of whose shorter n-grams are known to be frequent."""
        good = np.zeros(self.n + 1, bool)
        at = self.starts(m - 1)
        good[at[self.known(shorter, m - 1, at)[0]]] = True
        at = self.starts(m)
        return at[good[at] & good[at + 1]]

    def phrases(self, m: int, pointers: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts, counts and fingerprints of the n-grams with the pointers' fingerprints, by their words."""
        at = self.starts(m)
        hit, which = self.known(pointers, m, at)
        at = at[hit]
        same = np.ones(len(at), bool)
        for j in range(m):
            same &= self.codes[at + j] == self.codes[pointers[which] + j]
        places, counts = pointers, np.bincount(which[same], minlength=len(pointers))
        if not same.all():  # collisions within the block
            others = np.stack([self.codes[at[~same] + j] for j in range(m)], axis=1)
            _, first, n = np.unique(others, axis=0, return_index=True, return_counts=True)
            places = np.concatenate([places, at[~same][first]])
            counts = np.concatenate([counts, n])
        texts = self.words.take(pa.array(self.codes[places]))
        for j in range(1, m):
            texts = pc.binary_join_element_wise(texts, self.words.take(pa.array(self.codes[places + j])), " ")
        return texts, counts, self.prints(places, m)


def _cut(batches):
    """Blocks of one language: distinct words, and the words' codes, negative where a piece begins."""
    partition, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).cast(pa.binary())]
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            sizes, at = np.cumsum([len(t) for t in own]), 0
            while at < len(own):
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
                words, piece = cut_words(own[at:end])
                at = end
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                codes = coded.indices.to_numpy() + 1
                codes[np.concatenate([[True], piece[1:] != piece[:-1]])] *= -1
                packed = pa.compress(pa.py_buffer(codes.astype(np.int32)), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([partition << 32 | number]), pa.array([lang], pa.string()),
                    pa.array([len(codes)], pa.int64()), pa.array([packed], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
                ], names=["block", "lang", "n_words", "codes", "words"])
                number += 1


def _blocks(batch: pa.RecordBatch):
    """Block, pointers and the words of each row."""
    names = batch.schema.names
    for i in range(len(batch)):
        row = {name: batch.column(j)[i] for j, name in enumerate(names)}
        block = _Block(row["lang"].as_py(), row["words"].values, row["codes"].as_py(), row["n_words"].as_py())
        yield row["block"].as_py(), block, row


def _pointers(parts: pa.ListScalar) -> np.ndarray:
    return np.concatenate([np.frombuffer(p.as_buffer(), "<u4") for p in parts.values]).astype(np.int64)


def _shares(prints: np.ndarray, shares: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The share of each of these sorted fingerprints, by its leading bits, and the span of each share."""
    share = (prints >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1), len(share)]
    return share, list(zip(edges, edges[1:], strict=False))


def _fingerprints(m: int, shares: int):
    """Sends a block's distinct fingerprints, parted by their leading bits."""

    def run(batches):
        for batch in batches:
            for number, block, row in _blocks(batch):
                at = block.starts(1) if m == 1 else block.tried(m, _pointers(row["pointers"]))
                if not len(at):
                    continue
                prints, first, counts = np.unique(block.prints(at, m), return_index=True, return_counts=True)
                share, spans = _shares(prints, shares)
                binary = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    pa.array([share[a] for a, _ in spans], pa.int64()), pa.array([number] * len(spans)),
                    binary(prints.astype("<u8")), binary(counts.astype("<u4")), binary(at[first].astype("<u4")),
                ], names=["share", "block", "prints", "counts", "pointers"])

    return run


def _frequent(least: int):
    """Adds up the counts of one share of all fingerprints; pointers of frequent ones, by block."""

    def run(rows: pa.Table) -> pa.Table:
        def flat(name, kind):
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)])

        prints, counts, pointers = flat("prints", "<u8"), flat("counts", "<u4"), flat("pointers", "<u4")
        sizes = [len(x.as_buffer()) // 8 for x in rows.column("prints")]
        blocks = np.repeat(rows.column("block").to_numpy(), sizes)
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        new = np.concatenate([[True], prints[1:] != prints[:-1]])
        totals = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        kept = order[(totals >= least)[np.cumsum(new) - 1]]
        kept = kept[np.argsort(blocks[kept], kind="stable")]
        names, first = np.unique(blocks[kept], return_index=True)
        parts = [x.astype("<u4").tobytes() for x in np.split(pointers[kept], first[1:])] if len(kept) else []
        return pa.table({"block": pa.array(names, pa.int64()), "pointers": pa.array(parts, pa.binary())})

    return run


def _phrases(longest: int, shares: int):
    """Sends the frequent phrases of a block, parted by the leading bits of their fingerprints."""

    def run(batches):
        for batch in batches:
            for _, block, row in _blocks(batch):
                levels = {x["m"].as_py(): x["pointers"] for x in row["levels"].values}
                made = [block.phrases(m, _pointers(levels[m])) for m in range(1, longest + 1) if m in levels]
                prints = np.concatenate([x[2] for x in made])
                order = np.argsort(prints, kind="stable")
                share, spans = _shares(prints[order], shares)
                texts = pa.concat_arrays([x[0] for x in made]).take(pa.array(order))
                counts = np.concatenate([x[1] for x in made])[order]
                offsets = pa.array([0, *(b for _, b in spans)], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([share[a] for a, _ in spans], pa.int64()),
                    pa.array([row["lang"].as_py()] * len(spans), pa.string()),
                    pa.ListArray.from_arrays(offsets, texts),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ], names=["share", "lang", "phrases", "counts"])

    return run


def _counted(least: int):
    """Adds up the counts of one share of all phrases by their texts."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sizes = pc.list_value_length(rows.column("phrases")).to_numpy()
        flat = pa.table({
            "lang": rows.column("lang").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
            "phrase": pc.list_flatten(rows.column("phrases")), "a": pc.list_flatten(rows.column("counts"))})
        total = flat.group_by(["lang", "phrase"]).aggregate([("a", "sum")])
        total = total.filter(pc.greater_equal(total.column("a_sum"), least))
        m = pc.add(pc.count_substring(total.column("phrase"), " "), 1).cast(pa.int32())
        return pa.table({"lang": total.column("lang"), "m": m, "phrase": total.column("phrase"),
                         "a": total.column("a_sum")})

    return run


def frequent_phrases(
    docs: DataFrame, scratch: Scratch, least: int, longest: int, text_col: str = "text", lang_col: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, m, phrase, a) of 1 to ``longest`` words that occur ``least`` times, and (lang, n) words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    blocks = scratch.write(rows.mapInArrow(
        _cut, "block bigint, lang string, n_words bigint, codes binary, words array<string>"), "blocks")
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    shares = max(8, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // SHARE))
    levels = []
    for m in range(1, longest + 1):
        own = blocks if m == 1 else blocks.join(_by_block(levels[-1]), "block")
        sent = own.mapInArrow(
            _fingerprints(m, shares), "share bigint, block bigint, prints binary, counts binary, pointers binary")
        kept = sent.groupBy("share").applyInArrow(_frequent(least), "block bigint, pointers binary")
        levels.append(scratch.write(kept, f"frequent-{m}"))
    every = [_by_block(level).withColumn("m", F.lit(m)) for m, level in enumerate(levels, 1)]
    found = every[0]
    for level in every[1:]:
        found = found.unionByName(level)
    found = found.groupBy("block").agg(F.collect_list(F.struct("m", "pointers")).alias("levels"))
    phrases = blocks.join(found, "block").mapInArrow(
        _phrases(longest, shares), "share bigint, lang string, phrases array<string>, counts array<bigint>")
    counted = phrases.groupBy("share").applyInArrow(
        _counted(least), "lang string, m int, phrase string, a bigint")
    return scratch.write(counted, "phrases"), totals


def _by_block(level: DataFrame) -> DataFrame:
    """A row per block with its pointers, which are as many as it has distinct frequent n-grams at most."""
    return level.groupBy("block").agg(F.collect_list("pointers").alias("pointers"))


def collocations(
    docs: DataFrame,
    least: int = 30,
    longest: int = 4,
    covered: int = 80,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts a phrase, ``l`` and ``r`` the two parts at its weakest cut,
    ``n`` all words of the language, and the score is floor(2000000 * a / (l + r)).
    A phrase within a longer one that has ``covered`` percent of its count goes.

    Defined cases: a NULL language counts as ``und``, a NULL text as empty;
    repeated rows count each time; ties go by count, then by the phrase's bytes;
    an empty table, or one without frequent phrases, gives no rows; other
    columns of ``docs`` don't matter.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    frequent, totals = frequent_phrases(docs, scratch, least, longest, text_col, lang_col)
    several = frequent.where("m > 1").withColumn("w", F.split("phrase", " "))
    cuts = several.select("lang", "m", "phrase", "a", "w", F.explode(F.expr("sequence(1, m - 1)")).alias("k")).select(
        "lang", "m", "phrase", "a", "k",
        F.expr("array_join(slice(w, 1, k), ' ')").alias("first"),
        F.expr("array_join(slice(w, k + 1, m - k), ' ')").alias("rest"))
    part = lambda name, count: frequent.select(
        "lang", F.col("phrase").alias(name), F.col("a").alias(count))
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div "
                   "(cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    cut = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    weakest = cut.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    inside = several.where("m > 2").select(
        "lang", "m", "a", "w", F.explode(F.expr("sequence(2, m - 1)")).alias("size")).select(
        "lang", "a", "w", "size", F.explode(F.expr("sequence(1, m - size + 1)")).alias("at")).select(
        "lang", F.expr("array_join(slice(w, at, size), ' ')").alias("phrase"), "a")
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = weakest.join(longer, ["lang", "phrase"], "left").where(
        "longer is null or cast(100 as decimal(3, 0)) * cast(longer as decimal(19, 0)) "
        f"< cast({int(covered)} as decimal(3, 0)) * cast(a as decimal(19, 0))")
    rows = free.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    w = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
