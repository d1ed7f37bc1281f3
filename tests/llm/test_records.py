import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stowage.llm import records
from stowage.llm.tables import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  ", "Don't STOP  it's", "<|endoftext|> a</w>", "ΣΑΣ ΟΔΥΣΣΕΥΣ. ſ İ", "x　y\x85w q\x1cq",
         "日本語 テスト", "a" * 5000, "\x00b ​ c", "é ́x", "line\nfeed\n\n", "same", "same", "word " * 20_000]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def test_round_trip(spark, frame, library):
    rows = [(10 * i, t, 1, "x") for i, t in reversed(list(enumerate(TEXTS)))] + [(None, "first", 2, "y")]
    docs = frame(rows, "doc_id bigint, text string, start int, value string")
    folder = Scratch(spark, "records").folder
    records.write_records(docs, folder, PATH, 2)
    index = records.index_records(spark, folder)
    got = sorted(index.collect(), key=lambda r: (r["file"], r["place"]))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (doc_id, text, *_), row in zip(ordered, got, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        data = np.array(ids, "<u4").tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (
            doc_id, start, len(ids), zlib.crc32(data))
        start += len(ids)
    wanted = frame([(30, 2), (0, 1), (999, 3)], "doc_id bigint, turn int")
    picked = {r["doc_id"]: (r["turn"], r["ids"]) for r in
              records.read_records(spark, folder, wanted).collect()}
    assert set(picked) == {30, 0} and picked[0] == (1, [2])
    assert picked[30][1][:-1] == library.encode(TEXTS[3], add_special_tokens=False).ids
    assert records.read_records(spark, folder).count() == len(rows)


def test_one_id_many_rows_and_empty_table(spark, frame):
    docs = frame([(1, f"t{i % 3}") for i in range(30)], "doc_id bigint, text string")
    folder = Scratch(spark, "records").folder
    records.write_records(docs, folder, PATH, 2)
    index = records.index_records(spark, folder)
    assert index.count() == 30 and index.select("start").distinct().count() == 30
    folder = Scratch(spark, "records").folder
    records.write_records(frame([], "doc_id bigint, text string"), folder, PATH, 2)
    assert records.index_records(spark, folder).collect() == []


def test_damage_is_noticed():
    data = records.frame(5, b"\x01\x00\x02\x00", 2) + b"\n"
    assert [(a, n, d, list(i)) for a, n, d, i in records.frames(data * 2)] == [
        (0, len(data), 5, [1, 2]), (len(data), len(data), 5, [1, 2])]
    for at in (0, 9, 15, len(data) - 2):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))


def test_special_tokens_as_the_library_has_them(spark, frame):
    library = Tokenizer.from_file(PATH)
    texts = ["<|endoftext|> a", "a<|startoftext|>B<|endoftext|>. C", "<|ENDOFTEXT|> A", "é<|endoftext|>x", "Plain, TEXT."]
    folder = Scratch(spark, "records").folder
    docs = frame(list(enumerate(texts)), "doc_id bigint, text string")
    records.write_records(docs, folder, PATH, 2, special_as_text=False)
    records.index_records(spark, folder)
    got = {r["doc_id"]: list(r["ids"]) for r in records.read_records(spark, folder).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert 49407 in got[0] and 49406 in got[1]
