"""Alignment of two tokenizers by an inverted index of token pairs.

A byte-level tokenizer (A) and one of pieces (B) cut the same bytes. Where
tokens of both end, a group of tokens ends and the two tokens are linked. Per
pair of ids the index holds compressed bitmaps of the documents that link it,
as planes: plane k has the documents whose number of links has bit k set. Parts
of the index are OR-merged; documents are the set bits of all planes together,
links the set bits of plane k times 2 to the k. Counts per pair then go back
over the same postings, and each document sums what its pairs return.

Documents have numbers in blocks of 65,536. A bitmap of one block is a sorted
list of 16-bit numbers, or 8 KB of bits from 4,096 documents on.

Both tokenizers cut a text at a single space between two other characters that
are no white space, so words between such places are encoded once and remembered.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stowage.llm.tables import Scratch

#: Documents in a block, and set bits from which on a bitmap is kept as bits.
BLOCK, DENSE = 1 << 16, 4096
#: Words of documents whose pairs are sorted together, at least one document.
_PIECE_WORDS = 250_000
#: Words that a worker remembers, with this many characters in all.
_REMEMBERED, _CHARS = 300_000, 6_000_000
#: A space where a text may be cut, and what shows that not every space is one.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s | \s|^ | $")

_ALIGNED = ("block bigint, pos int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
            "groups_sha256 string, a int, b int, plane int, n int, bits binary")
_INDEX = "a int, b int, block bigint, plane int, n int, n_docs int, bits binary"


@lru_cache(maxsize=2)
def _tokenizers(definition: str, model: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_str(definition)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _Pair(first, second, _byte_letters())


def _byte_letters() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte.

    Printable bytes stand for themselves, the others for the characters from
    256 on, in ascending order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class _Aligned:
    """Alignments of words, one after the other: counts per word, their linked pairs, groups as text."""

    def __init__(self, good=(), n_a=(), n_b=(), n_links=(), pairs=(), groups=()):
        self.good = np.array(good, bool)
        self.n_a, self.n_b, self.n_links, self.pairs = (
            np.array(x, np.int64) for x in (n_a, n_b, n_links, pairs))
        self.groups = list(groups)

    def add(self, other: _Aligned) -> None:
        for name in ("good", "n_a", "n_b", "n_links", "pairs"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        self.groups += other.groups

    def kept(self, which: np.ndarray) -> _Aligned:
        """Those of the words, which are in order."""
        own = np.zeros(len(self.good), bool)
        own[which] = True
        return _Aligned(self.good[which], self.n_a[which], self.n_b[which], self.n_links[which],
                        self.pairs[np.repeat(own, self.n_links)], [self.groups[i] for i in which])

    def pairs_of(self, codes: np.ndarray) -> np.ndarray:
        """The linked pairs of words by their numbers, one after the other."""
        n = self.n_links[codes]
        starts = (np.cumsum(self.n_links) - self.n_links)[codes]
        ends = np.cumsum(n)
        return self.pairs[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class _Pair:
    """Two tokenizers and the words that they have encoded."""

    def __init__(self, first, second, letters: dict[str, int]):
        self.first, self.second = first, second
        vocabulary = first.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            known = all(c in letters for c in entry)
            self.bytes_a[i] = bytes(letters[c] for c in entry) if known else entry.encode()
        self.bytes_b = [self._piece(second, i) for i in range(second.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in xs]) for xs in (self.bytes_a, self.bytes_b))
        # An id's text where its group goes on, and where its side of the group ends.
        self.text_a = np.array([f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"], object)
        self.text_b = np.array([f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"], object)
        self.forget()

    @staticmethod
    def _piece(second, i: int) -> bytes:
        piece = second.id_to_piece(i)
        if second.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace("▁", " ").encode()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Forgets all words, or all but some."""
        if keep is None:
            self.index, self.known, self.uses, self.chars = {}, _Aligned(), np.zeros(0, np.int64), 0
            return
        words = list(self.index)
        self.index = {words[i]: n for n, i in enumerate(keep)}
        self.known, self.uses = self.known.kept(keep), self.uses[keep] // 4
        self.chars = sum(map(len, self.index))

    def codes(self, words: list[str]) -> np.ndarray:
        """The numbers of these words among ``known``; new ones are encoded."""
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if len(self.index) + len(new) > _REMEMBERED or self.chars > _CHARS:
            # Words that came once mostly don't return.
            again = np.flatnonzero(self.uses > 1)
            self.forget(again if len(again) < _REMEMBERED // 2 and self.chars <= _CHARS else None)
            new = [w for w in dict.fromkeys(words) if w not in self.index]
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self.uses = np.bincount(codes, minlength=len(self.index)) + np.pad(
            self.uses, (0, len(self.index) - len(self.uses)))
        return codes

    def _learn(self, words: list[str]) -> None:
        # Words with white space at an edge can't stand beside others.
        edges = [not w or w[0].isspace() or w[-1].isspace() for w in words]
        plain = [w for w, edge in zip(words, edges, strict=True) if not edge]
        for part in [plain, *([w] for w, edge in zip(words, edges, strict=True) if edge)]:
            self._store(part)

    def _store(self, words: list[str]) -> None:
        """Remembers words; where the bytes of some don't come back, halves lead to these."""
        if not words:
            return
        found = self.align(words)
        if found is None and len(words) > 1:
            self._store(words[: len(words) // 2])
            self._store(words[len(words) // 2 :])
            return
        self.known.add(found or _Aligned([False], [0], [0], [0], [], [""]))
        for word in words:
            self.index[word] = len(self.index)
            self.chars += len(word)

    def align(self, words: list[str]) -> _Aligned | None:
        """Alignments of words that may stand side by side; None if not all bytes come back."""
        texts = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        found = self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        a = list(chain.from_iterable(e.ids for e in found))
        b = list(chain.from_iterable(self.second.encode(texts, num_threads=1)))
        parts = [(" " + w).encode("utf-8", "surrogatepass") for w in words]
        whole = b"".join(parts)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(
                map(self.bytes_b.__getitem__, b)) != whole:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        marks = np.zeros((2, len(whole) + 1), bool)
        marks[0, end_a], marks[1, end_b] = True, True
        ends_a, ends_b = marks[1, end_a], marks[0, end_b]  # a group ends with these tokens
        last_a, last_b = np.flatnonzero(ends_a), np.flatnonzero(ends_b)
        words_end = np.cumsum([len(p) for p in parts])
        if not (marks[0, words_end] & marks[1, words_end]).all():
            return None
        # Groups as text: a group's A ids, then its B ids.
        tokens_a, tokens_b = (np.concatenate([[0], x + 1]) for x in (last_a, last_b))
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + tokens_b[group_a]] = self.text_a[2 * a + ends_a]
        out[np.arange(len(b)) + tokens_a[group_b + 1]] = self.text_b[2 * b + ends_b]
        groups = np.concatenate([[0], np.searchsorted(end_a[last_a], words_end) + 1])
        n_a, n_b = tokens_a[groups], tokens_b[groups]
        texts, at = out.tolist(), (n_a + n_b).tolist()
        return _Aligned(np.ones(len(words), bool), np.diff(n_a), np.diff(n_b), np.diff(groups),
                        a[last_a] << 32 | b[last_b], ["".join(texts[i:j]) for i, j in zip(at, at[1:], strict=False)])


def cut_words(text: str) -> list[str]:
    """A text's parts between which both tokenizers always cut, without the spaces there."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def _postings(pairs: np.ndarray, positions: np.ndarray):
    """Per plane of the number of links per document: pairs, plane, set bits and bitmaps."""
    kinds, codes = np.unique(pairs, return_inverse=True)
    both, links = np.unique(codes.astype(np.int64) << 16 | positions, return_counts=True)
    planes = []
    for plane in range(int(links.max()).bit_length()):
        some = both[(links >> plane) & 1 == 1]
        kind, n = np.unique(some >> 16, return_counts=True)
        planes.append((kinds[kind], np.full(len(n), plane), n, _bitmaps(some & 0xFFFF, n)))
    return planes


def _align(definition, model):
    def run(batches):
        pair = _tokenizers(definition.value, model.value)
        partition, number = TaskContext.get().partitionId(), 0
        kinds = pa.schema([(n, t) for n, t in (
            ("block", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
            ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
            ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()),
            ("n", pa.int32()), ("bits", pa.binary()))])

        def table(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds],
                schema=kinds)

        def piece(start: int, docs: list, texts: list):
            block = partition << 32 | start >> 16
            at = (start & 0xFFFF) + np.arange(len(docs))
            cut = [cut_words(t) if t else [] for t in texts]
            codes = pair.codes(list(chain.from_iterable(cut)))
            known, bounds = pair.known, np.concatenate([[0], np.cumsum([len(c) for c in cut])])

            def sums(of: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(of[codes])])[bounds])

            counts = [sums(x) for x in (known.n_a, known.n_b, known.n_links)]
            groups = known.groups
            digests = [sha256("".join([groups[c] for c in codes[i:j].tolist()])[:-1].encode()).hexdigest() if i < j else ""
                       for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            links, places = [known.pairs_of(codes)], [np.repeat(at, counts[2])]
            broken = np.flatnonzero(sums(~known.good))
            if len(broken):  # the whole text decides
                links[0] = links[0][~np.isin(places[0], at[broken])]
                places[0] = places[0][~np.isin(places[0], at[broken])]
            for i in broken:
                whole = pair.align([texts[i]]) or _Aligned([True], [0], [0], [0], [], [""])
                for column, own in zip(counts, (whole.n_a, whole.n_b, whole.n_links), strict=True):
                    column[i] = own[0]
                digests[i] = sha256(whole.groups[0][:-1].encode()).hexdigest() if whole.groups[0] else ""
                links.append(whole.pairs)
                places.append(np.full(len(whole.pairs), at[i]))
            links, places = np.concatenate(links), np.concatenate(places)
            named = dict(zip(("n_a", "n_b", "n_links", "n_groups"), (*counts, counts[2]), strict=True))
            yield table({"block": pa.array([block] * len(docs)), "pos": pa.array(at),
                         "doc_id": pa.array(docs, pa.int64()), "groups_sha256": pa.array(digests, pa.string())}
                        | {n: pa.array(x) for n, x in named.items()}, len(docs))
            if len(links):
                for pairs, plane, n, bits in _postings(links, places):
                    for i in range(0, len(n), 20_000):
                        part = slice(i, i + 20_000)
                        size = len(n[part])
                        yield table({
                            "block": pa.array([block] * size), "a": pa.array(pairs[part] >> 32),
                            "b": pa.array(pairs[part] & 0xFFFFFFFF), "plane": pa.array(plane[part]),
                            "n": pa.array(n[part]), "bits": bits.slice(i, size)}, size)

        for batch in batches:
            docs, texts = (batch.column(i).to_pylist() for i in range(2))
            at = 0
            while at < len(docs):
                start, words, end = number, 0, at
                while end < len(docs) and words < _PIECE_WORDS and (end == at or number & 0xFFFF):
                    words += (texts[end] or "").count(" ") + 1
                    end, number = end + 1, number + 1
                yield from piece(start, docs[at:end], texts[at:end])
                at = end

    return run


def _positions(n: np.ndarray, bits: pa.Array) -> np.ndarray:
    """The numbers of all bitmaps, one after the other."""
    data = np.frombuffer(bits.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
    dense = np.flatnonzero(n >= DENSE)
    out, done = [], 0
    for i in [*dense, len(n)]:
        out.append(data[offsets[done] : offsets[i]].view("<u2"))
        if i < len(n):
            out.append(np.flatnonzero(np.unpackbits(data[offsets[i] : offsets[i + 1]], bitorder="little")))
        done = i + 1
    return np.concatenate(out).astype(np.int64)


def _bitmaps(numbers: np.ndarray, n: np.ndarray) -> pa.Array:
    """Bitmaps with these counts of sorted numbers."""
    if not (n >= DENSE).any():
        offsets = np.concatenate([[0], np.cumsum(n) * 2]).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(numbers.astype("<u2"))]
        return pa.Array.from_buffers(pa.binary(), len(n), buffers)
    out = []
    for part in np.split(numbers, np.cumsum(n)[:-1]):
        if len(part) < DENSE:
            out.append(part.astype("<u2").tobytes())
        else:
            marks = np.zeros(BLOCK, np.uint8)
            marks[part] = 1
            out.append(np.packbits(marks, bitorder="little").tobytes())
    return pa.array(out, pa.binary())


def _merge(batches):
    """OR-merges rows, sorted by (a, b, block), into one bitmap per plane; counts documents."""

    def merged(rows: pa.Table):
        rows = rows.combine_chunks()
        a, b, block, plane = (rows.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "block", "plane"))
        n = rows.column("n").to_numpy().astype(np.int64)
        bits = rows.column("bits").combine_chunks()
        bits = bits.chunk(0) if isinstance(bits, pa.ChunkedArray) else bits
        numbers = _positions(n, bits)
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (block[1:] != block[:-1])
        group = np.cumsum(new) - 1
        # One number per (group, plane, document), then per (group, document).
        own, layer = np.repeat(group, n), np.repeat(plane, n)
        planes = np.unique((own << 21 | layer << 16) | numbers) if len(numbers) else numbers
        firsts, counts = np.unique(planes >> 16, return_counts=True)
        docs = np.bincount(np.unique(planes >> 21 << 16 | planes & 0xFFFF) >> 16, minlength=group[-1] + 1)
        of = firsts >> 5
        head = np.ones(len(of), bool)
        head[1:] = of[1:] != of[:-1]
        at = np.flatnonzero(new)[of]
        return pa.RecordBatch.from_arrays([
            pa.array(a[at], pa.int32()), pa.array(b[at], pa.int32()), pa.array(block[at]),
            pa.array(firsts & 31, pa.int32()), pa.array(counts, pa.int32()),
            pa.array(np.where(head, docs[of], 0), pa.int32()), _bitmaps(planes & 0xFFFF, counts),
        ], names=["a", "b", "block", "plane", "n", "n_docs", "bits"])

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        # The last group may go on in the next batch.
        keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "block")])
        cut = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0))[-1]) + 1 if (
            keys != keys[:, -1:]).any() else 0
        if cut:
            yield merged(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield merged(rest)


def _return(batches):
    """Per document of a block: sums over its postings, from rows sorted by block."""
    block, best, total = None, None, None

    def out():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), block)), pa.array(at, pa.int32()), pa.array(best[at]), pa.array(total[at])],
            names=["block", "pos", "n_best", "count_sum"])

    for batch in batches:
        if not len(batch):
            continue
        blocks = batch.column(0).to_numpy()
        n = batch.column(2).to_numpy().astype(np.int64)
        numbers, ends = _positions(n, batch.column(3)), np.concatenate([[0], np.cumsum(n)])
        links = np.int64(1) << batch.column(1).to_numpy().astype(np.int64)
        score = links * batch.column(4).to_numpy()
        wins = links * batch.column(5).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
        for start, end in zip(edges, edges[1:], strict=False):
            if blocks[start] != block:
                if block is not None:
                    yield out()
                block = blocks[start]
                best, total = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            at = numbers[ends[start] : ends[end]]
            np.add.at(total, at, np.repeat(score[start:end], n[start:end]))
            np.add.at(best, at, np.repeat(wins[start:end], n[start:end]))
    if block is not None:
        yield out()


def build_index(
    docs: DataFrame, scratch: Scratch, tokenizer_path: str, model_path: str,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The documents with their counts and places, and the inverted index of pairs, both written.

    The index has a row per pair, block and plane: ``a``, ``b``, ``block``,
    ``plane``, ``n`` set bits, ``bits``, and on the first plane ``n_docs``, the
    documents of all planes.
    """
    context = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as definition, open(model_path, "rb") as model:
        shared = context.broadcast(definition.read()), context.broadcast(model.read())
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    aligned = scratch.write(rows.mapInArrow(_align(*shared), _ALIGNED), "aligned")
    postings = aligned.where("a is not null").select("a", "b", "block", "plane", "n", "bits")
    index = scratch.write(
        postings.repartition("a", "b", "block").sortWithinPartitions("a", "b", "block")
        .mapInArrow(_merge, _INDEX), "index")
    own = aligned.where("a is null").select(
        "block", "pos", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return own, index


def pair_counts(index: DataFrame) -> DataFrame:
    """Per pair of ids: ``n_docs`` documents and ``n_links`` links, from the set bits of its planes."""
    return index.groupBy("a", "b").agg(
        F.sum("n_docs").alias("n_docs"),
        F.sum(F.expr("cast(n as bigint) << plane")).alias("n_links"))


def align_tokenizers(
    docs: DataFrame, tokenizer_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: ``doc_id``, token counts ``n_a`` and ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256``.

    A pair's count is its number of links in all documents; ``n_best`` are the
    links whose count is the highest one of their B id, ``count_sum`` sums the
    counts of all links of the document.

    Defined cases: a NULL or empty text, and one whose bytes either tokenizer
    doesn't give back, has no tokens: zeros and an empty digest. Every row is a
    document of its own, also with a repeated or NULL id; an empty table gives
    an empty one; other columns of ``docs`` don't matter.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    own, index = build_index(docs, scratch, tokenizer_path, model_path, id_col, text_col)
    counts = scratch.write(pair_counts(index).drop("n_docs"), "counts")
    highest = counts.groupBy("b").agg(F.max("n_links").alias("highest"))  # a row per id of B's vocabulary
    scored = counts.join(F.broadcast(highest), "b").select(
        "a", "b", F.col("n_links").alias("count"), (F.col("n_links") == F.col("highest")).alias("best"))
    back = index.join(scored, ["a", "b"]).select("block", "plane", "n", "bits", "count", "best")
    sums = back.repartition("block").sortWithinPartitions("block").mapInArrow(
        _return, "block bigint, pos int, n_best bigint, count_sum bigint")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    return own.join(sums, ["block", "pos"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
