import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from stowage.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "   ", "\n\n a  b", "don't  we'll  x", "日本語のテキスト、これはテスト", "a" * 3000 + " b",
    "ÀÉ" * 200, "x　y\t\t z\x85w", "-" * 700, "Ѐ привет мир 123456 ½ Ⅷ", "a\x01b \x02c\x01\x02", "\x01\x02 \x02\x01",
    "<|endoftext|> is text", "👩‍👩‍👧 é", "same", "same",
    " ".join(random.Random(4).choice("alpha beta gamma été über".split()) for _ in range(30_000)),
    "".join(chr(random.Random(i).randint(33, 0x2FFF)) for i in range(3000)),
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_like_the_library_and_back(frame, library):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)]
    docs = frame(rows, "doc_id bigint, text string, words string, ids array<int>")
    tokens = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert tokens.columns == ["doc_id", "ids"]
    got = {r["doc_id"]: r for r in bpe.decode(tokens, PATH).withColumn(
        "le", bpe.little_endian(F.col("ids"), PATH)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        want = library.encode_ordinary(text or "")
        assert got[doc_id]["ids"] == want, (text or "")[:40]
        assert bytes(got[doc_id]["decoded"]) == (text or "").encode()
        assert bytes(got[doc_id]["le"]) == b"".join(i.to_bytes(4, "little") for i in want)


def test_every_token_is_found(frame, library):
    """The fold gives each token that is a text of its own as the library does."""
    words = sorted(t.decode() for t in bpe.read_ranks(PATH) if t.isascii())[::7]
    found = frame([(w,) for w in words], "w string").select(
        "w", bpe.fold_merges(F.col("w"), PATH).alias("ids")).collect()
    ranks = bpe.read_ranks(PATH)
    assert all(r["ids"] == [ranks[r["w"].encode()]] for r in found)


def test_repeated_rows_and_empty_table(frame, library):
    ddl = "doc_id string, text string"
    rows = bpe.encode(frame([("a", "x y"), ("a", "x y")], ddl), PATH, public_tokenizers.PATTERN).collect()
    assert [tuple(r) for r in rows] == [("a", library.encode_ordinary("x y"))] * 2
    assert bpe.encode(frame([], ddl), PATH, public_tokenizers.PATTERN).collect() == []
    odd = bpe.decode(frame([(None,), ([],), ([99_999],)], "ids array<int>"), PATH).collect()
    assert [bytes(r["decoded"]) for r in odd] == [b"", b"", b""]


def test_words_are_folded_together(library):
    """All lengths in one call, slices too; a word at a time took the JVM most of the query's time."""
    rng = random.Random(5)
    words = ["a" * n for n in range(300)] + ["".join(rng.choice("aeinrst é日") for _ in range(rng.randint(1, 70)))
                                             for _ in range(2000)]
    table = bpe._rank_map(PATH)
    own = tiktoken.Encoding("one", pat_str=r"[\s\S]+", mergeable_ranks=table.ranks, special_tokens={})
    for some in (pa.array(words), pa.array(words).slice(3, 500), pa.array([], pa.string())):
        flat, counts = bpe.fold_words(some, table)
        want = [own.encode_ordinary(w) for w in some.to_pylist()]
        assert counts.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])


def test_tokens_taken_as_they_are():
    """A token that no merge makes is the id of the match that it equals, and of no other."""
    table = bpe._rank_map(PATH)
    odd = bpe.RankMap(table.starts, table.entries, table.byte_ids, table.ranks, {"qxqz": 7})
    words = pa.array(["qxqz", "qxqzq", "the", "qxqz"])
    flat, counts = bpe.fold_words(words, odd)
    plain, sizes = bpe.fold_words(words, table)
    assert counts.tolist() == [1, *sizes[1:3], 1]
    assert flat.tolist() == [7, *plain[sizes[0] : sizes[:3].sum()], 7]


def test_no_fold_in_expressions(frame, library):
    docs = frame([(1, "some words")], "doc_id bigint, text string")
    tokens = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("MapInArrow") == 1


def test_ids_that_are_none(frame):
    rows = [(None,), ([],), ([5, None, -1, 70_000, 6],)]
    got = frame(rows, "ids array<int>").select(bpe.little_endian(F.col("ids"), PATH).alias("le")).collect()
    assert [r["le"] and bytes(r["le"]) for r in got] == [None, b"", bytes([5, 0, 0, 0, 6, 0, 0, 0])]
