import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import quality as ql

DDL = "doc_id bigint, text string, score string"
LABELS = "doc_id bigint, quality int, text string"


def _texts(n=240):
    rng = np.random.default_rng(2)
    words = "the house and water of morning light with stone over river".split()
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(5, 300)))
        if i % 3 == 0:  # one bad part in a longer text
            text = text + " " + "BUY!! NOW!! $$$ " * 20 + text
        rows.append((i, text, "x"))
        labels.append((i, int(i % 3 != 0), None))
    return rows, labels


def test_gradient():
    rng = np.random.default_rng(1)
    counts = np.array([2, 1, 3])
    x = rng.normal(size=(6, ql.FEATURES)).astype(np.float32)
    y = np.array([1, 0, 1], np.float32)
    p = {k: v.astype(np.float64) for k, v in ql.fit(x, counts, y).parameters.items()}
    loss = lambda: -(y * np.log(s := ql._forward(p, x, counts)[0]) + (1 - y) * np.log(1 - s)).mean()
    g = ql._gradient(p, x, counts, y)
    for name in g:
        at = tuple(0 for _ in p[name].shape)
        old, h = p[name][at], 1e-5
        p[name][at] = old + h
        up = loss()
        p[name][at] = old - h
        down = loss()
        p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-7), name


def test_held_out_documents(frame):
    rows, labels = _texts()
    docs = frame(rows, DDL)
    model = ql.train(docs, frame([r for r in labels if r[0] % 2], LABELS))
    out = ql.score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == bool(q) for i, q, _ in labels if i % 2 == 0]
    assert np.mean(right) > 0.95


def test_odd_texts_and_labels(frame):
    rows, labels = _texts(60)
    docs = frame(rows, DDL)
    extra = [(0, None, None), (None, 1, None), (77777, 1, None), (1, 0, None), (1, 0, None)]
    model = ql.train(docs, frame(labels + extra, LABELS), max_docs=50)
    odd = [(1, None, None), (2, "", None), (3, " \n", None), (4, "x" * 300_000, None), (5, "é👩", None),
           (6, "same", "a"), (6, "same", "a"), (None, "no id", None)]
    got = ql.score_quality(frame(odd, DDL), model, keep=["doc_id"]).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == by_id[2] and len({r["score"] for r in got if r["doc_id"] == 6}) == 1
    assert ql.score_quality(frame([], DDL), model).collect() == []
    for none in ([], [(1, 1, None), (2, 1, None)]):
        flat = ql.train(docs, frame(none, LABELS))
        assert flat.parameters is None
        assert {r[0] for r in ql.score_quality(docs, flat).select("score").collect()} == {0.5 if not none else 1.0}


def test_passages_alone_as_in_a_batch():
    texts = [b"", b"a", b"word " * 500, "é".encode() * 400, b" " * 700]
    features, counts = ql.passages(texts)
    assert counts.tolist() == [1, 1, 8, 3, 3]
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert np.array_equal(features[at : at + n], ql.passages([text])[0])
        at += n


def test_scores_on_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = ql.score_quality(docs, ql.train(docs, labels.where(~held)), keep=["doc_id"])
    rows = out.where(held).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]) > 0.95


def test_memory_of_features_is_bounded():
    """Features of a batch of long texts take some 100 MB; 8 MB of text at once took more than 400."""
    texts = ["Some words, and 12 more of them. " * 3000] * 200
    tracemalloc.start()
    for _, part in ql._batches(texts):
        ql.passages(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000
