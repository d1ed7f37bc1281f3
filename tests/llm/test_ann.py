import numpy as np
import pytest

from stowage.llm import ann
from stowage.llm.tables import Scratch

DDL = "vec_id bigint, embedding array<float>, score int"


def brute(rows, queries, k):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q in queries:
            found = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), i)
                           for i, w in good if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_over_shards(spark, frame):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 24))
    x = (centers[rng.integers(0, 30, 2500)] + 0.4 * rng.normal(size=(2500, 24))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vectors = frame([(*r, 1) for r in rows], DDL)
    scratch = Scratch(spark, "ann")
    index = ann.build_index(vectors, scratch, 5, shard_rows=400)
    assert index.count() == 7
    assert sum(len(r["ids"]) for r in index.select("ids").collect()) == 2500
    got = _found(ann.search_index(index, vectors.where("vec_id % 25 = 0"), 5))
    want = brute(rows, set(range(0, 2500, 25)), 5)
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert hits >= 0.95
    for q in want:
        scores = dict(want[q])
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in got[q] if i in scores)


def test_copies_odd_vectors_and_few_candidates(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(40, 20, -1)]
    rows += [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (50, [0.0, -0.0]),
             (7, [1.0, -2.0]), (8, [3e38, 3e38]), (9, [1e-38, 1e-38]), (10, [2.0, 4.0]), (100, [1.0, 1.0, 1.0]),
             (150, [2.0, 2.0, 1.0]), (200, [5.0])]
    vectors = frame([(*r, None) for r in rows], DDL)
    got = _found(ann.nearest(vectors, vectors, 5))
    want = brute(rows, {i for i, _ in rows}, 5)
    assert set(got) == {q for q, found in want.items() if found}
    assert [i for i, _ in got[30]] == [i for i, _ in want[30]][:5] == [10, 21, 22, 23, 24]
    assert got[100] == [(150, pytest.approx(want[100][0][1]))]
    assert {i for i, _ in got[8]} == {i for i, _ in want[8]}


def test_empty_table(frame):
    none = frame([], DDL)
    assert ann.nearest(none, none, 5).collect() == []


def test_repeated_ids_are_cut_once(frame):
    """Before, six rows of one id took all places of their vector."""
    rows = [(3, [1.0, 2.0])] * 40 + [(i, [1.0, 2.0]) for i in (7, 8, 9)] + [(1, [2.0, 1.0]), (2, [-1.0, 0.0])]
    vectors = frame([(*r, None) for r in rows], DDL).repartition(3)
    got = _found(ann.nearest(vectors, vectors.where("vec_id = 1"), 5))
    assert [i for i, _ in got[1]] == [3, 7, 8, 9, 2]


def test_multiples_are_ties(frame):
    """Before, k + 3 of the multiples were found, not those with the smallest ids."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(m), 2.0 * m, -3.0 * m]) for i, m in enumerate(rng.permutation(np.arange(1, 201)).tolist(), 10)]
    rows += [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(100, 3)), 1000)]
    vectors = frame([(*r, None) for r in rows + [(1, [1.0, 2.0, -3.1])]], DDL)
    got = _found(ann.nearest(vectors, vectors.where("vec_id in (1, 50)"), 5))
    assert [i for i, _ in got[1]] == [10, 11, 12, 13, 14]
    assert [i for i, _ in got[50]] == [10, 11, 12, 13, 14]
    assert len({s for _, s in got[1]}) == 1


def test_many_near_vectors_of_one_id(frame):
    rows = [(1, [1.0, i / 1000]) for i in range(300)] + [(i, [-1.0, float(i)]) for i in range(2, 12)]
    vectors = frame([(*r, None) for r in rows], DDL)
    got = _found(ann.nearest(vectors, vectors.where("vec_id = 1").limit(1), 5))
    assert [i for i, _ in got[1]] == [11, 10, 9, 8, 7]


def test_recall_with_shards_as_in_use(spark, frame):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(60, 24))
    x = (centers[rng.integers(0, 60, 9000)] + 0.4 * rng.normal(size=(9000, 24))).astype(np.float32)
    vectors = frame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], DDL)
    index = ann.build_index(vectors, Scratch(spark, "ann"), 5)
    assert index.count() == 3
    got = _found(ann.search_index(index, vectors.where("vec_id % 50 = 0"), 5))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = []
    for q in range(0, 9000, 50):
        near = unit @ unit[q]
        near[q] = -np.inf
        hits.append(len({i for i, _ in got[q]} & set(np.argsort(-near)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.95


def test_recall_on_given_vectors(spark):
    """With the production shard size, over a table that fills one shard, and over small shards."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([i for i, _ in rows])
    for shard_rows in (ann.SHARD_ROWS, 300):
        index = ann.build_index(vectors, Scratch(spark, "ann"), 5, shard_rows=shard_rows)
        got = _found(ann.search_index(index, vectors.where("vec_id % 50 = 0"), 5))
        hits = []
        for at in np.flatnonzero(ids % 50 == 0):
            cosine = x @ x[at]
            cosine[at] = -2
            want = ids[np.argsort(-cosine, kind="stable")[:5]]
            hits.append(len({i for i, _ in got[ids[at]]} & set(want.tolist())) / 5)
        assert np.mean(hits) >= 0.9
