import itertools

import numpy as np
import pyarrow as pa
import pytest

from stowage.llm import langid

WORDS = {"aa": "the and with house water morning those", "bb": "der und mit haus wasser morgen diese",
         "cc": "дом вода утро который это"}
DDL = "doc_id bigint, text string, lang string, score string"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(w.split(), 30)), lang, "x")
            for i, (lang, w) in enumerate(list(WORDS.items()) * 20)]
    rows += [(900, None, "aa", None), (901, "text", None, None)]
    return langid.train(spark.createDataFrame(rows, DDL))


def test_best_path_is_the_best():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 4, 1, 6, 3])
    scores = rng.normal(0, 2, (int(lengths.sum()), 3)).astype(np.float32)
    path = langid.best_paths(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        value = lambda p: sum(own[i, s] for i, s in enumerate(p)) - 1.5 * sum(
            a != b for a, b in itertools.pairwise(p))
        if n:
            assert value(path[at : at + n]) == pytest.approx(
                max(map(value, itertools.product(range(3), repeat=int(n)))), abs=1e-4)
        at += n


def test_spans_scripts_and_odd_texts(frame, model):
    mixed = " ".join([WORDS["aa"]] * 3) + ". " + " ".join([WORDS["bb"]] * 5)
    texts = [WORDS["aa"], WORDS["bb"], WORDS["cc"], mixed, None, "", "12 !?", "漢字", "WASSER und HAUS",
             WORDS["bb"] + " " + "x" * 100_000, "the " * 50_000]
    rows = [(i, t, "zz", "clash") for i, t in enumerate(texts)] + [(0, texts[0], None, None)]
    out = langid.identify(frame(rows, DDL), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "spans"]
    got = {}
    for r in out.collect():
        if r["doc_id"] in got:
            assert got[r["doc_id"]][:3] == (r["lang_pred"], r["score"], r["spans"])
        got[r["doc_id"]] = (r["lang_pred"], r["score"], r["spans"])
    assert [got[i][0] for i in range(4)] == ["aa", "bb", "cc", "bb"]
    assert [s["lang"] for s in got[3][2]] == ["aa", "bb"]
    assert mixed[got[3][2][1]["start"]:].startswith("der")
    assert [got[i][:2] for i in (4, 5, 6)] == [("und", 0.0)] * 3
    assert got[7][0] in WORDS and got[7][1] == 0.0  # a script of no learned language
    assert got[8][0] == "bb" and got[10][0] == "aa"
    assert all(0 <= v[1] <= 1 for v in got.values())


def test_nothing_to_learn_from_and_empty_table(frame, model):
    none = langid.train(frame([(1, "text", None, None)], DDL))
    assert [r["lang_pred"] for r in langid.identify(frame([(1, "a", None, None)], DDL), none).collect()] == ["und"]
    assert langid.identify(frame([], DDL), model).collect() == []


def test_numbers_are_no_letters_and_many_languages(frame, model):
    texts = ["½ ² ①", "Ⅷ ⅓", "the ½ house", "一 二"]
    out = {r["doc_id"]: r for r in langid.identify(frame([(i, t, None, None) for i, t in enumerate(texts)], DDL), model).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1)] == ["und", "und"] and out[0]["score"] == 0.0 and out[0]["spans"] == []
    assert out[2]["lang_pred"] == "aa" and out[3]["score"] == 0.0
    lengths = np.array([5, 3])
    scores = np.full((8, 300), -50.0, np.float32)
    want = [299, 299, 150, 150, 150, 128, 128, 128]
    scores[np.arange(8), want] = 0
    assert langid.best_paths(scores, lengths, 1.0).tolist() == want


def test_a_column_named_like_a_working_one(frame, model):
    rows = frame([(1, "the house", "kept", "zz")], "doc_id bigint, text string, __text string, text_ string")
    row = langid.identify(rows, model).first()
    assert (row["__text"], row["text_"], row["lang_pred"]) == ("kept", "zz", "aa")


def test_held_out_accuracy_on_given_documents(spark):
    from stowage.llm.queries import op3_language_id

    folder = "/root/testdata/sf0.01"
    found = op3_language_id(spark, folder).where("held_out").join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null")
    hits = found.selectExpr("avg(cast(lang = lang_pred as double)) as a", "count(*) as n").first()
    assert hits["n"] > 100 and hits["a"] >= 0.95


def test_batches_are_cut_by_their_words():
    """Labels are found for some 300,000 words at once, whatever a batch of rows holds."""
    texts = ["word " * 200_000, None, "", "é " * 400_000, *["some words here"] * 50_000]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = list(langid._parts(batch))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert len(parts) > 2 and langid.WORDS_PER_BATCH <= 300_000
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1_500_000 for p in parts)
    assert list(langid._parts(batch.slice(0, 0))) == []
