import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stowage.llm import alignment
from stowage.llm.tables import Scratch

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DDL = "doc_id bigint, text string, block int, n_a string"


def brute(rows):
    """Everything from whole texts, without cutting them into words."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment._byte_letters()
    names = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab().items()}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    made, counts = [], Counter()
    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(names[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            a = b = []
        ends = []
        for ids, name in ((a, names.get), (b, piece)):
            at, out = 0, {}
            for i in ids:
                at += len(name(i))
                out.setdefault(at, []).append(i)
            ends.append(out)
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(x, y) for e in common for x in ends[0][e] for y in ends[1][e]]
        groups, low = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for at in sorted(s) if low < at <= e for i in s[at]) for s in ends))
            low = e
        made.append((doc, len(a), len(b), len(common), links, ";".join(groups)))
        counts.update(links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted((doc or 0, a, b, g, len(links), sum(counts[p] == best[p[1]] for p in links),
                   sum(counts[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if links else "")
                  for doc, a, b, g, links, s in made), counts


TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "  two  spaces \n and lines\n\nhere\t tab", "▁ literal", "a▁b",
    "<|endoftext|> and </s> <s> <unk> <0x41>", "don't won't 's  's we'll ' re", "naïve café — 日本語 テキスト 한국어",
    "emoji 👩‍👩‍👧 🇩🇪 é  nbsp em ​zero ﻿bom", "x\x00y \x1f z \x85 w", "12345 67.89 1,000",
    "word " * 3000, "l" * 5000, "the the the the", "The cat. The dog! the cat", "\r\n \r\n", "A᠎B ᠎ C",
    "ﬁ Å Å ① ½", "tab\tand space \t mixed", "a  b   c    d     e",
]


def rows_of(out):
    return sorted((r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                   r["groups_sha256"]) for r in out.collect())


def test_like_whole_texts(frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "the cat"), (3, "the cat"), (None, "the dog")]
    docs = frame([(*r, 1, "x") for r in rows], DDL).repartition(3)
    assert rows_of(alignment.align_tokenizers(docs, A, B)) == brute(rows)[0]
    assert alignment.align_tokenizers(frame([], DDL), A, B).collect() == []


@pytest.mark.parametrize(("piece", "dense"), [(3, 2), (40, 4096)])
def test_index_merges_parts(spark, frame, monkeypatch, piece, dense):
    texts = ["the cat the", "the", None, "a dog the dog"] * 40
    monkeypatch.setattr(alignment, "_PIECE_WORDS", piece)
    monkeypatch.setattr(alignment, "DENSE", dense)
    docs = [(i, t) for i, t in enumerate(texts)]
    import pyarrow as pa

    class Held:
        def __init__(self, value):
            self.value = value

    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        run = alignment._align(Held(a.read()), Held(b.read()))
    monkeypatch.setattr(alignment, "TaskContext", type("T", (), {"get": staticmethod(
        lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    batch = pa.record_batch([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    parts = pa.Table.from_batches(run([batch]))
    rows = parts.filter(pa.compute.is_valid(parts["a"])).select(["a", "b", "block", "plane", "n", "bits"])
    rows = rows.sort_by([("a", "ascending"), ("b", "ascending"), ("block", "ascending")])
    index = pa.Table.from_batches(alignment._merge(rows.to_batches(max_chunksize=7)))
    docs_of, links = Counter(), Counter()
    for r in index.to_pylist():
        docs_of[r["a"], r["b"]] += r["n_docs"]
        links[r["a"], r["b"]] += r["n"] << r["plane"]
    want = brute(docs)[1]
    assert links == want
    single = [brute([d])[1] for d in docs[:4]]
    assert docs_of == Counter({p: 40 * sum(p in s for s in single) for p in want})


def test_pair_counts(spark, frame):
    docs = frame([(i, "the the cat", 0, "") for i in range(50)] + [(99, "the", 0, "")], DDL)
    _, index = alignment.build_index(docs, Scratch(spark, "x"), A, B)
    got = {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in alignment.pair_counts(index).collect()}
    assert sorted(got.values()) == [(50, 50), (51, 101)]


def test_cut_words():
    assert alignment.cut_words("a b c") == ["a", "b", "c"]
    assert alignment.cut_words(" a  b c\n d e ") == [" a  b", "c\n d", "e "]
